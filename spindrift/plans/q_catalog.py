"""Queries on the catalog: streams, chunks, days, agents, retention, skipping."""

from __future__ import annotations

from pyspark.sql import functions as F

from spindrift.functions.filters import matches
from spindrift.operators import catalog as C
from spindrift.operators import retention as R
from spindrift.operators import search as S
from spindrift.operators import skipping
from spindrift.plans.views import CHUNKS, LINES, SECTIONS, chunks, labels_text, log_lines, sections, table

NS = 10**9
NOW = 1706745600 * NS  # 2024-02-01
TODAY = "20240201"
DAY = 86_400 * NS
CAP = 200_000
OVERRIDES = [("prod/pay*", 5 * DAY), ("edge-1/*", 3 * DAY), ("*/db", 90 * DAY)]
AGE = 20 * DAY


def streams(spark, d):
    return C.streams_of(sections(spark, d))


def stream_catalog_upsert(spark, d):
    return streams(spark, d).withColumn("labels", labels_text())


def list_streams(spark, d):
    return C.listed(streams(spark, d), S.Selector(cluster="edge-*").column([]) & (F.col("last_ts") >= 1706400000 * NS), 25).select(*C.KEY, "last_ts")


def sel_since(spark, d):
    s = streams(spark, d)
    return s.filter(S.Selector(since=1706572800 * NS).column(s.columns)).select(*C.KEY, "last_ts")


def stream_tree_pods(spark, d):
    return C.pod_tree(streams(spark, d)).withColumns({"containers": F.array_join("containers", ","), "labels": labels_text()})


def stream_tree(spark, d):
    t = C.tree(streams(spark, d))
    return t.select("cluster", F.array_join(F.transform("namespaces", lambda n: F.concat(n["ns"], F.lit(":"), F.array_join(F.transform(n["pods"], lambda p: F.concat(p["pod"], F.lit("("), p["uid"], F.lit(")"))), "+"))), " ").alias("tree"))


def stats_streams(spark, d):
    return C.stream_stats(streams(spark, d))


def stats_days(spark, d):
    return C.day_stats(chunks(spark, d))


def stats_chunks(spark, d):
    return C.chunk_stats(chunks(spark, d))


def chunk_summary(spark, d):
    return C.chunks_of(log_lines(spark, d))


def chunk_overlap(spark, d):
    some = log_lines(spark, d).filter("cluster = 'prod'").select("sid").distinct()
    return C.overlapping(chunks(spark, d), 1704700000 * NS, 1704900000 * NS, some).select("sid", "day")


def scan_budget(spark, d):
    return C.days_in_budget(chunks(spark, d), 1704412800 * NS, 1705276800 * NS, 20_000)


def heartbeats(spark, d):
    e = table(spark, d, "events")
    n = F.col("event_id")
    stats = F.concat(F.lit("files="), n % 7, F.lit(";lag_bytes="), n, F.lit(";junk;rss=12"), n % 10, F.lit(";dropped="), F.when(n % 2 == 0, "x").otherwise("3"), F.lit(";files="), n % 11)
    return e.select(F.when(F.col("user_id") % 2 == 0, "prod").otherwise("edge-1").alias("cluster"), F.concat(F.lit("node-"), (F.col("user_id") % 4).cast("string")).alias("node"), n.alias("seen"), F.lit("1.1").alias("version"), stats.alias("stats"))


def agents_latest(spark, d):
    return C.agents(heartbeats(spark, d))


def ingest_counters(spark, d):
    return C.ingest_counters(log_lines(spark, d))


def ingest_rate_10s(spark, d):
    near = log_lines(spark, d).withColumn("ts_ns", F.col("seq") * 137_000_000)  # close enough to fill windows
    return C.ingest_rate(near)


def tail_lag(spark, d):
    return C.lag(table(spark, d, "events").select((F.col("event_id") % 1000).alias("size"), (F.col("user_id") * 7).alias("offset")))


def orphan_streams(spark, d):
    s = log_lines(spark, d).groupBy("sid").agg(F.max("ts_ns").alias("last_ts"))
    return C.orphans(s, chunks(spark, d).filter("sid % 4 <> 0"), 1706500000 * NS).select("sid")


def orphan_cursors(spark, d):
    cursors = log_lines(spark, d).select("sid", F.concat(F.lit("f"), F.col("seq") % 3).alias("file")).distinct()
    return cursors.join(log_lines(spark, d).filter("sid % 5 <> 0").select("sid").distinct(), "sid", "left_anti")


def index_vs_disk(spark, d):
    path = F.concat(F.col("day"), F.lit("/"), F.col("sid").cast("string"))
    c = chunks(spark, d)
    return C.compared(c.filter("sid % 7 <> 0").select(path.alias("path")), c.filter("sid % 11 <> 0").select(path.alias("path")))


def path_prefix(spark, d):
    c = chunks(spark, d).select(F.concat_ws("/", "day", "cluster", "ns", F.col("sid").cast("string")).alias("path"))
    return c.filter(F.col("path").startswith("20240115/prod/"))


def retention_age(spark, d):
    return R.expired_days(chunks(spark, d), NOW, AGE, TODAY)


def retention_override(spark, d):
    return R.overridden(chunks(spark, d), NOW, AGE, OVERRIDES, TODAY)


def retention_override_longer(spark, d):
    return R.overridden(chunks(spark, d), NOW, AGE, OVERRIDES, TODAY, longer=True)


def retention_disk_cap(spark, d):
    return R.beyond_cap(chunks(spark, d), CAP, TODAY)


def offload_candidates(spark, d):
    return R.offload_candidates(chunks(spark, d), 1705276800 * NS).select("sid", "day")


def evict_candidates(spark, d):
    return R.evict_candidates(chunks(spark, d)).select("sid", "day")


def trigram_prune_sound(spark, d):
    """Files (documents by source) that the skipping table keeps, and matching lines that it would lose: none."""
    docs = table(spark, d, "documents").select(F.col("source").alias("file"), F.col("text").alias("msg"))
    kept = skipping.candidates(skipping.trigram_table(docs), "licensed apache").withColumn("kept", F.lit(True))
    hits = docs.filter(matches("msg", "licensed apache")).groupBy("file").agg(F.count(F.lit(1)).alias("n"))
    return hits.join(kept, "file", "left").select("file", "n", F.coalesce("kept", F.lit(False)).alias("kept"))


def trigram_prune_absent(spark, d):
    """No file can have a literal whose trigrams no line has."""
    docs = table(spark, d, "documents").select(F.col("source").alias("file"), F.col("text").alias("msg"))
    return skipping.candidates(skipping.trigram_table(docs), "qqxzzy wvvkq").select("file")


def skip_files(spark, d):
    """Files (log lines by their kind) that cannot have the word: all but one."""
    lines = log_lines(spark, d).withColumn("file", F.regexp_extract("msg", r"/v1/(\w+)", 1))
    return skipping.ruled_out(skipping.trigram_table(lines), "purchase")


_STREAMS = f"with {SECTIONS} "
_END = "epoch_us(strptime(day, '%Y%m%d')) * 1000 + 86400000000000"
_CHUNKS = f"with {CHUNKS} "
_RULES = f"cluster || '/' || ns like 'prod/pay%' and {NOW} - ({_END}) > {5 * DAY} or cluster || '/' || ns like 'edge-1/%' and {NOW} - ({_END}) > {3 * DAY}"

QUERIES = {
    f.__name__: f
    for f in (
        stream_catalog_upsert, list_streams, sel_since, stream_tree_pods, stream_tree, stats_streams, stats_days, stats_chunks, chunk_summary, chunk_overlap, agents_latest,
        ingest_counters, ingest_rate_10s, tail_lag, orphan_streams, orphan_cursors, index_vs_disk, path_prefix, retention_age, retention_override, retention_override_longer,
        retention_disk_cap, offload_candidates, evict_candidates, trigram_prune_sound, trigram_prune_absent,
        skip_files, scan_budget,
    )
}

SQL = {
    "stream_catalog_upsert": _STREAMS + "select cluster, ns, pod, uid, ctr, restarts, first_ts, last_ts, ended, node, labels from streams",
    "list_streams": _STREAMS + f"select cluster, ns, pod, uid, ctr, last_ts from streams where cluster ilike 'edge-%' and last_ts >= {1706400000 * NS} order by last_ts desc, cluster, ns, pod, uid, ctr limit 25",
    "sel_since": _STREAMS + f"select cluster, ns, pod, uid, ctr, last_ts from streams where last_ts >= {1706572800 * NS}",
    "stream_tree_pods": _STREAMS + """select cluster, ns, pod, uid, max(restarts) as restarts, max(last_ts) as last_ts, not bool_or(ended) as live, arg_max(node, (last_ts, ctr)) as node,
        arg_max(labels, (last_ts, ctr)) filter (labels is not null) as labels, string_agg(ctr, ',' order by ctr) as containers from streams group by cluster, ns, pod, uid""",
    "stream_tree": _STREAMS + """, p as (select distinct cluster, ns, pod, uid from streams),
        n as (select cluster, ns, string_agg(pod || '(' || uid || ')', '+' order by pod, uid) as pods from p group by 1, 2)
        select cluster, string_agg(ns || ':' || pods, ' ' order by ns) as tree from n group by 1""",
    "stats_streams": _STREAMS + "select count(*) as streams, count(*) filter (not ended) as live from streams",
    "stats_days": _CHUNKS + "select day, sum(case when local then bytes else 0 end)::bigint as bytes from chunks group by day",
    "stats_chunks": _CHUNKS + "select count(*) as chunks, coalesce(sum(bytes) filter (local), 0)::bigint as local_bytes, count(*) filter (remote) as remote, count(*) filter (remote and not local) as remote_only from chunks",
    "chunk_summary": _CHUNKS + "select sid, day, min_ts, max_ts, lines, bytes, restarts from chunks",
    "chunk_overlap": _CHUNKS + f"select sid, day from chunks where cluster = 'prod' and min_ts <= {1704900000 * NS} and max_ts >= {1704700000 * NS}",
    "scan_budget": _CHUNKS + f""", p as (select day, sum(bytes)::bigint as bytes from chunks where min_ts <= {1705276800 * NS} and max_ts >= {1704412800 * NS} group by day)
        select day, bytes, coalesce(sum(bytes) over (order by day desc rows between unbounded preceding and 1 preceding), 0) <= 20000 as scanned from p""",
    "skip_files": "select distinct event_type as file from events where event_type <> 'purchase'",
    "agents_latest": """with h as (select case when user_id % 2 = 0 then 'prod' else 'edge-1' end as cluster, 'node-' || (user_id % 4) as node, event_id as seen from events)
        select cluster, node, max(seen) as seen, '1.1' as version, max(seen) % 11 as files, max(seen) as lag_bytes, 0::bigint as spool_bytes, case when max(seen) % 2 = 0 then 0 else 3 end::bigint as dropped,
        120 + max(seen) % 10 as rss from h group by 1, 2""",
    "ingest_counters": f"with {LINES} select count(*) as lines, sum(strlen(msg) + 13)::bigint as bytes from lines",
    "ingest_rate_10s": "select (event_id * 137000000 // 10000000000) * 10 as start_s, (count(*) // 10)::bigint as rate from events group by 1",
    "tail_lag": "select coalesce(sum(greatest(event_id % 1000 - user_id * 7, 0)), 0)::bigint as lag from events",
    "orphan_streams": f"with {LINES} select sid from lines where sid % 4 = 0 group by sid having max(ts_ns) < {1706500000 * NS}",
    "orphan_cursors": f"with {LINES} select distinct sid, 'f' || (seq % 3) as file from lines where sid % 5 = 0",
    "index_vs_disk": _CHUNKS + """select day || '/' || sid as path, case when sid % 7 = 0 then 'not indexed' else 'missing' end as problem from chunks where (sid % 7 = 0) <> (sid % 11 = 0)""",
    "path_prefix": _CHUNKS + "select day || '/' || cluster || '/' || ns || '/' || sid as path from chunks where day = '20240115' and cluster = 'prod'",
    "retention_age": _CHUNKS + f"select distinct day from chunks where {NOW} - ({_END}) > {AGE}",
    "retention_override": _CHUNKS + f"select distinct day, cluster, ns from chunks where {_RULES}",
    "retention_override_longer": _CHUNKS + f"select distinct day, cluster, ns from chunks where {_RULES} or ns = 'db' and {NOW} - ({_END}) > {90 * DAY}",
    "retention_disk_cap": _CHUNKS + f""", p as (select day, sum(case when local then bytes else 0 end)::bigint as bytes from chunks group by day)
        select day, bytes from (select *, sum(bytes) over (order by day desc) as held from p) where held > {CAP} and bytes > 0""",
    "offload_candidates": _CHUNKS + f"select sid, day from chunks where not remote and max_ts < {1705276800 * NS} order by max_ts, sid, day limit 200",
    "evict_candidates": _CHUNKS + "select sid, day from chunks where remote and local order by max_ts, sid, day limit 200",
    "trigram_prune_sound": "select source as file, count(*) as n, true as kept from documents where contains(lower(text), 'licensed') and contains(lower(text), 'apache') group by source",
    "trigram_prune_absent": "select source as file from documents where false",
}
