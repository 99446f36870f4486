"""Engine tables derived from the shared test tables, each as a DataFrame and as the DuckDB text of the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spindrift.functions.lines import day


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def log_lines(spark: SparkSession, sf_dir: str, streaming: bool = False) -> DataFrame:
    """Events as log lines."""
    if streaming:
        schema = table(spark, sf_dir, "events").schema
        e = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    else:
        e = table(spark, sf_dir, "events")
    user, kind = F.col("user_id"), F.col("event_type")
    cents = F.round(F.col("value") * 100).cast("long").cast("string")
    msg = F.concat(F.lit('{"level":"'), kind, F.lit('","user":'), user.cast("string"), F.lit(',"cents":'), cents, F.lit(',"msg":"'), kind, F.lit(" on /v1/"), kind, F.lit('"}'))
    return e.select(
        F.col("event_id").alias("seq"),
        F.when(user % 2 == 0, "prod").otherwise("edge-1").alias("cluster"),
        F.when(user % 3 == 0, "payments").when(user % 3 == 1, "db").otherwise("shop").alias("ns"),
        F.concat(F.lit("api-"), (user % 5).cast("string")).alias("pod"),
        F.concat(F.lit("uid-"), (user % 10).cast("string")).alias("uid"),
        F.when(kind == "error", "sidecar").otherwise("app").alias("ctr"),
        user.alias("sid"),
        (F.unix_micros(F.col("ts").cast("timestamp")) * 1000).alias("ts_ns"),
        (kind == "error").alias("stderr"),
        (user % 2).cast("int").alias("restart"),
        F.when(user % 3 == 0, F.create_map(F.lit("app"), F.lit("api"), F.lit("team"), F.lit("pay"))).otherwise(F.create_map(F.lit("app"), F.lit("api"))).alias("labels"),
        F.coalesce(msg, F.lit("")).alias("msg"),
    )


LINES = """lines as (
  select event_id as seq, case when user_id % 2 = 0 then 'prod' else 'edge-1' end as cluster,
    case user_id % 3 when 0 then 'payments' when 1 then 'db' else 'shop' end as ns, 'api-' || (user_id % 5) as pod, 'uid-' || (user_id % 10) as uid,
    case when event_type = 'error' then 'sidecar' else 'app' end as ctr, user_id as sid, epoch_us(ts) * 1000 as ts_ns, event_type = 'error' as stderr,
    (user_id % 2)::int as restart, user_id % 3 = 0 as paid,
    '{"level":"' || event_type || '","user":' || user_id || ',"cents":' || round(value * 100)::bigint || ',"msg":"' || event_type || ' on /v1/' || event_type || '"}' as msg
  from events
)"""


def sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A section a stream and day of the log lines."""
    lines = log_lines(spark, sf_dir).withColumn("day", day(F.col("ts_ns")))
    return lines.groupBy("cluster", "ns", "pod", "uid", "ctr", "day").agg(
        F.min("ts_ns").alias("min_ts"),
        F.max("ts_ns").alias("max_ts"),
        F.count(F.lit(1)).alias("n"),
        F.max("restart").alias("restart"),
        F.max("seq").alias("seq"),
        F.bool_or(F.col("seq") % 97 == 0).alias("ended"),
        F.concat(F.lit("node-"), F.max(F.col("seq") % 4).cast("string")).alias("node"),
        F.max_by(F.when(F.col("seq") % 2 == 0, F.col("labels")), "seq").alias("labels"),
    )


# the labels of a section: those of its last line, where that line's number is even
SECTIONS = (
    LINES
    + """, sections as (
  select cluster, ns, pod, uid, ctr, strftime(make_timestamp(ts_ns // 1000), '%Y%m%d') as day, min(ts_ns) as min_ts, max(ts_ns) as max_ts, count(*) as n,
    max(restart) as restart, max(seq) as seq, bool_or(seq % 97 = 0) as ended, 'node-' || max(seq % 4) as node,
    case when max(seq) % 2 = 0 then case when arg_max(paid, seq) then 'app=api,team=pay' else 'app=api' end end as labels
  from lines group by all
), streams as (
  select cluster, ns, pod, uid, ctr, max(restart) as restarts, min(min_ts) as first_ts, max(max_ts) as last_ts, bool_or(ended) as ended, arg_max(node, seq) as node,
    arg_max(labels, seq) filter (labels is not null) as labels
  from sections group by all
)"""
)


def labels_text() -> F.Column:
    """A label map as sorted text; maps themselves don't compare across engines."""
    return F.array_join(F.array_sort(F.transform(F.map_entries("labels"), lambda e: F.concat(e["key"], F.lit("="), e["value"]))), ",")


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A chunk a stream id and day; every third is in the object store, every sixth there only."""
    from spindrift.operators.catalog import chunks_of

    c = chunks_of(log_lines(spark, sf_dir))
    where = log_lines(spark, sf_dir).select("sid", "cluster", "ns").distinct()
    return c.join(where, "sid").withColumns({"remote": F.col("sid") % 3 == 0, "local": F.col("sid") % 6 != 0})


CHUNKS = (
    LINES
    + """, chunks as (
  select sid, cluster, ns, strftime(make_timestamp(ts_ns // 1000), '%Y%m%d') as day, min(ts_ns) as min_ts, max(ts_ns) as max_ts, count(*) as lines,
    sum(strlen(msg) + 13)::bigint as bytes, max(restart) as restarts, sid % 3 = 0 as remote, sid % 6 <> 0 as local
  from lines group by all
)"""
)
