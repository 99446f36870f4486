"""The catalog as aggregations over append-only facts: streams, chunks, days, agents, integrity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spindrift.functions.lines import as_timestamp, day, heartbeat_stats, stored_bytes

MAX_SCAN_BYTES = 2 << 30
KEY = ("cluster", "ns", "pod", "uid", "ctr")


def streams_of(sections: DataFrame) -> DataFrame:
    """A row a stream of its sections (KEY, node, restart, min_ts, max_ts, ended, labels, seq).

    A zero first time does not count, once ended is ended, the last node and labels that say something stay.
    """
    said = F.col("node").isNotNull() & (F.col("node") != "")
    return sections.groupBy(*KEY).agg(
        F.max("restart").alias("restarts"),
        F.coalesce(F.min(F.nullif("min_ts", F.lit(0))), F.lit(0)).alias("first_ts"),
        F.max("max_ts").alias("last_ts"),
        F.bool_or("ended").alias("ended"),
        F.max_by(F.when(said, F.col("node")), F.when(said, F.col("seq"))).alias("node"),
        F.max_by("labels", F.when(F.col("labels").isNotNull(), F.col("seq"))).alias("labels"),
    )


def listed(streams: DataFrame, predicate: Column, limit: int = 100_000) -> DataFrame:
    return streams.filter(predicate).orderBy(F.desc("last_ts"), *KEY).limit(limit)


def pod_tree(streams: DataFrame) -> DataFrame:
    """A row a pod: restarts, last_ts, live (no container ended), labels, and its containers by name."""
    latest = F.struct("last_ts", "ctr")
    some = F.col("labels").isNotNull() & (F.size("labels") > 0)
    return streams.groupBy("cluster", "ns", "pod", "uid").agg(
        F.max("restarts").alias("restarts"),
        F.max("last_ts").alias("last_ts"),
        (~F.bool_or("ended")).alias("live"),
        F.max_by("node", latest).alias("node"),
        F.max_by(F.when(some, F.col("labels")), F.when(some, latest)).alias("labels"),
        F.transform(F.array_sort(F.collect_list(F.struct("ctr", "last_ts", "ended"))), lambda c: c["ctr"]).alias("containers"),
    )


def tree(streams: DataFrame) -> DataFrame:
    """A row a cluster with its namespaces and pods nested, all by name."""
    by_ns = pod_tree(streams).groupBy("cluster", "ns").agg(F.array_sort(F.collect_list(F.struct("pod", "uid", "restarts", "last_ts", "live", "containers"))).alias("pods"))
    return by_ns.groupBy("cluster").agg(F.array_sort(F.collect_list(F.struct("ns", "pods"))).alias("namespaces"))


def stream_stats(streams: DataFrame) -> DataFrame:
    return streams.agg(F.count(F.lit(1)).alias("streams"), F.count_if(~F.col("ended")).alias("live"))


def chunks_of(lines: DataFrame, key: str = "sid") -> DataFrame:
    """A row a stream and day: what a sealed file's footer says."""
    return lines.withColumn("day", day(F.col("ts_ns"))).groupBy(key, "day").agg(
        F.min("ts_ns").alias("min_ts"), F.max("ts_ns").alias("max_ts"), F.count(F.lit(1)).alias("lines"), F.sum(stored_bytes(F.col("msg"))).alias("bytes"), F.max("restart").alias("restarts")
    )


def chunk_stats(chunks: DataFrame) -> DataFrame:
    """Totals over chunks with flags local and remote."""
    own = lambda c: F.coalesce(F.sum(F.when(c, F.col("bytes"))), F.lit(0))
    return chunks.agg(
        F.count(F.lit(1)).alias("chunks"), own(F.col("local")).alias("local_bytes"), F.count_if("remote").alias("remote"), F.count_if(F.col("remote") & ~F.col("local")).alias("remote_only")
    )


def day_stats(chunks: DataFrame) -> DataFrame:
    return chunks.groupBy("day").agg(F.sum(F.when(F.col("local"), F.col("bytes")).otherwise(0)).alias("bytes")).orderBy("day")


def overlapping(chunks: DataFrame, start: int, end: int, sids: DataFrame | None = None) -> DataFrame:
    """Chunks that may have lines of the range, of the given streams."""
    out = chunks.filter((F.col("min_ts") <= end) & (F.col("max_ts") >= start))
    return out.join(sids.select("sid"), "sid", "left_semi") if sids is not None else out


def days_in_budget(chunks: DataFrame, start: int, end: int, max_bytes: int = MAX_SCAN_BYTES) -> DataFrame:
    """(day, bytes, scanned) of the chunks that may have lines of the range; newest days first, a day is scanned while
    those after it hold at most ``max_bytes``."""
    held = overlapping(chunks, start, end).groupBy("day").agg(F.sum("bytes").alias("bytes"))
    later = Window.orderBy(F.desc("day")).rowsBetween(Window.unboundedPreceding, -1)  # a row a day
    return held.withColumn("scanned", F.coalesce(F.sum("bytes").over(later), F.lit(0)) <= max_bytes)


def orphans(streams: DataFrame, chunks: DataFrame, cutoff: int) -> DataFrame:
    """Streams without chunks that have been silent since the cutoff."""
    return streams.filter(F.col("last_ts") < cutoff).join(chunks.select("sid"), "sid", "left_anti")


def compared(index: DataFrame, disk: DataFrame) -> DataFrame:
    """Paths of the catalog against paths found: only in the index, only on disk."""
    both = index.select("path", F.lit(True).alias("i")).join(disk.select("path", F.lit(True).alias("d")), "path", "full_outer")
    return both.filter(F.col("i").isNull() | F.col("d").isNull()).select("path", F.when(F.col("d").isNull(), "missing").otherwise("not indexed").alias("problem"))


def agents(heartbeats: DataFrame) -> DataFrame:
    """The latest heartbeat of each (cluster, node), its numbers read; what is unknown or no number is 0."""
    last = heartbeats.groupBy("cluster", "node").agg(F.max(F.struct("seen", "version", "stats")).alias("h"))
    m = heartbeat_stats(F.col("h.stats"))
    number = lambda k: F.coalesce(F.try_element_at(m, F.lit(k)).try_cast("long"), F.lit(0).cast("long")).alias(k)
    return last.select("cluster", "node", F.col("h.seen").alias("seen"), F.col("h.version").alias("version"), *[number(k) for k in ("files", "lag_bytes", "spool_bytes", "dropped", "rss")])


def ingest_counters(lines: DataFrame) -> DataFrame:
    return lines.agg(F.count(F.lit(1)).alias("lines"), F.sum(stored_bytes(F.col("msg"))).alias("bytes"))


def ingest_rate(lines: DataFrame, seconds: int = 10) -> DataFrame:
    """Lines a second in tumbling windows, whole numbers."""
    w = F.window(as_timestamp(F.col("ts_ns")), f"{seconds} seconds")
    out = lines.groupBy(w.alias("w")).agg(F.count(F.lit(1)).alias("n"))
    return out.select(F.unix_seconds("w.start").alias("start_s"), F.floor(F.col("n") / seconds).alias("rate"))


def lag(files: DataFrame) -> DataFrame:
    return files.agg(F.coalesce(F.sum(F.greatest(F.col("size") - F.col("offset"), F.lit(0))), F.lit(0)).alias("lag"))


def metrics_text(values: dict[str, int], prefix: str = "spindrift") -> str:
    """Gauges in the text format that scrapers read."""
    return "".join(f"# TYPE {prefix}_{k} gauge\n{prefix}_{k} {v}\n" for k, v in sorted(values.items()))


def status(streams: DataFrame, chunks: DataFrame, heartbeats: DataFrame) -> dict:
    """What a status page shows; a few rows each."""
    return {**stream_stats(streams).first().asDict(), **chunk_stats(chunks).first().asDict(), "days": {r.day: r.bytes for r in day_stats(chunks).collect()}, "agents": [r.asDict() for r in agents(heartbeats).orderBy("cluster", "node").collect()]}
