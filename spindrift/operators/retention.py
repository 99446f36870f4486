"""What goes when: age, overrides, the disk cap, offload and eviction, as plans over the chunk catalog."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spindrift.functions import globs

DAY_NS = 86_400 * 10**9


def day_end_ns(day: Column) -> Column:
    return F.unix_seconds(F.to_timestamp(day, "yyyyMMdd")) * 10**9 + DAY_NS


def expired_days(days: DataFrame, now: int, max_age: int, today: str) -> DataFrame:
    """Days that ended longer ago than the age allows; never today."""
    return days.select("day").distinct().filter((F.lit(now) - day_end_ns(F.col("day")) > max_age) & (F.col("day") != today))


def overridden(chunks: DataFrame, now: int, max_age: int, overrides: list[tuple[str, int]], today: str, longer: bool = False) -> DataFrame:
    """(day, cluster, ns) that a rule ``cluster/ns`` -> age lets go; rules count only if they shorten the age, unless ``longer``."""
    parts = chunks.select("day", "cluster", "ns").distinct()
    old = F.lit(False)
    for match, age in overrides:
        if 0 < age < max_age or longer and age > 0:
            old |= globs.allows(F.concat_ws("/", "cluster", "ns"), match) & (F.lit(now) - day_end_ns(F.col("day")) > age)
    return parts.filter(old & (F.col("day") != today))


def beyond_cap(chunks: DataFrame, cap: int, today: str) -> DataFrame:
    """Oldest days to drop until the local bytes fit; never today, and never a day that frees nothing.

    The window runs over one row a day.
    """
    per = chunks.groupBy("day").agg(F.sum(F.when(F.col("local"), F.col("bytes")).otherwise(0)).alias("bytes"))
    newer = Window.orderBy(F.desc("day")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return per.withColumn("held", F.sum("bytes").over(newer)).filter((F.col("held") > cap) & (F.col("day") != today) & (F.col("bytes") > 0)).select("day", "bytes")


def offload_candidates(chunks: DataFrame, cutoff: int, limit: int = 200) -> DataFrame:
    return chunks.filter(~F.col("remote") & (F.col("max_ts") < cutoff)).orderBy("max_ts", "sid", "day").limit(limit)


def evict_candidates(chunks: DataFrame, limit: int = 200) -> DataFrame:
    return chunks.filter(F.col("remote") & F.col("local")).orderBy("max_ts", "sid", "day").limit(limit)


def drop_partitions(spark, root: str, parts: list[dict[str, str]]) -> int:
    """Delete partition folders (day, or day/cluster/ns) of a stored table; returns how many were there."""
    jvm, n = spark._jvm, 0
    for p in parts:
        path = jvm.org.apache.hadoop.fs.Path("/".join([root, *(f"{k}={v}" for k, v in p.items())]))
        n += bool(path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True))
    return n
