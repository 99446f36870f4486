"""Ordered folds of one file's or stream's rows, as windows: merging, grouping, dedup, limits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def merge_partial(df: DataFrame, file: str = "file", order: str = "off", max_bytes: int | None = None, end: str | None = None) -> DataFrame:
    """Pieces of one line joined: file, n, off (of the first), ts_ns, stderr, msg.

    A run of partial pieces and the full one after it are one line; time and stream are the first piece's;
    pieces left at the end of a file are a line. With ``max_bytes`` a line is let go once it has so many bytes,
    asked from its second piece on; this cuts inside a run, which stays in one array. ``end`` is a column more, of the last piece.
    """
    w = Window.partitionBy(file).orderBy(order)
    after_full = F.coalesce(F.lag(~F.col("partial")).over(w), F.lit(False)).cast("int")
    run = F.sum(after_full).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    ends = [end] if end else []
    piece = F.struct(F.col(order).alias("off"), "ts_ns", "stderr", "msg", *ends)
    groups = df.withColumn("_run", run).groupBy(file, "_run").agg(F.array_sort(F.collect_list(piece)).alias("p"))
    if max_bytes is None:
        lines = groups.select(file, F.col("p").alias("g"))
    else:
        empty = F.struct(F.array().cast("array<int>").alias("cuts"), F.lit(0).alias("size"), F.lit(0).alias("i"), F.lit(0).alias("start"))

        def step(acc: Column, p: Column) -> Column:
            size = acc["size"] + F.octet_length(p["msg"])
            cut = (acc["i"] > acc["start"]) & (size >= max_bytes)
            i = acc["i"] + 1
            return F.struct(
                F.when(cut, F.array_append(acc["cuts"], i)).otherwise(acc["cuts"]).alias("cuts"), F.when(cut, 0).otherwise(size).alias("size"), i.alias("i"), F.when(cut, i).otherwise(acc["start"]).alias("start")
            )

        cuts = F.aggregate("p", empty, step, lambda acc: acc["cuts"])
        stops = F.array_distinct(F.concat(cuts, F.array(F.size("p"))))
        spans = F.transform(stops, lambda e, i: F.struct(F.coalesce(F.get(stops, i - 1), F.lit(0)).alias("a"), e.alias("b")))
        lines = groups.select(file, "p", F.explode(spans).alias("s")).select(file, F.slice("p", F.col("s.a") + 1, F.col("s.b") - F.col("s.a")).alias("g"))
    first = F.get("g", F.lit(0))
    return lines.select(file, F.size("g").alias("n"), first["off"].alias("off"), first["ts_ns"].alias("ts_ns"), first["stderr"].alias("stderr"), F.array_join(F.transform("g", lambda x: x["msg"]), "").alias("msg"), *[F.element_at("g", -1)[c].alias(c) for c in ends])


def join_multiline(df: DataFrame, starts: Column, file: str = "file", order: str = "off", max_lines: int = 200, first: tuple[str, ...] = (), last: tuple[str, ...] = ()) -> DataFrame:
    """Events of a start line and what follows it: file, off, n, msg (joined by line breaks), and columns of the first and the last line.

    A file's first line starts one, a line that ``starts`` does, and a line that would be one too many.
    """
    w = Window.partitionBy(file).orderBy(order)
    running = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    begun = df.withColumn("_g", F.sum(F.coalesce(starts, F.lit(False)).cast("int")).over(running))
    part = F.floor((F.row_number().over(Window.partitionBy(file, "_g").orderBy(order)) - 1) / max_lines)
    out = begun.withColumn("_s", part).groupBy(file, "_g", "_s").agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("off"), "msg", *first, *last))).alias("p"))
    more = [F.get("p", F.lit(0))[c].alias(c) for c in first] + [F.element_at("p", -1)[c].alias(c) for c in last]
    return out.select(file, F.get("p", F.lit(0))["off"].alias("off"), F.size("p").alias("n"), F.array_join(F.transform("p", lambda x: x["msg"]), "\n").alias("msg"), *more)


def accepted_sections(df: DataFrame, keys: tuple[str, ...] = ("sid", "file"), seq: str = "seq") -> DataFrame:
    """Sections that reach beyond all before them of the same stream and file; ``cursor`` is where it stood.

    An overlap that goes on further is taken whole.
    """
    before = Window.partitionBy(*keys).orderBy(seq).rowsBetween(Window.unboundedPreceding, -1)
    seen = df.withColumn("cursor", F.coalesce(F.max("off_end").over(before), F.lit(0).cast("long")))
    return seen.filter(F.col("off_end") > F.col("cursor"))


def restart_boundaries(df: DataFrame, key: str = "sid") -> DataFrame:
    """Lines whose restart differs from the line before, with both numbers."""
    w = Window.partitionBy(key).orderBy("ts_ns", "seq")
    return df.withColumn("before", F.lag("restart").over(w)).filter(F.col("before") != F.col("restart"))


def rate_limited(df: DataFrame, per_second: int, file: str = "file", marker: str = "dropped") -> DataFrame:
    """At most ``per_second`` lines of a file in a second of event time; each line that passes after some that did not says how many.

    The batch stand-in for a token bucket on arrival time: column ``dropped_before`` and a marker text.
    """
    second = F.floor(F.col("ts_ns") / 1_000_000_000)
    rank = F.row_number().over(Window.partitionBy(file, second).orderBy("ts_ns", "seq"))
    flagged = df.repartition(file).withColumn("_ok", rank <= per_second)  # one exchange serves both windows
    run = Window.partitionBy(file).orderBy("ts_ns", "seq").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    counted = flagged.withColumn("_d", F.sum((~F.col("_ok")).cast("int")).over(run)).filter("_ok")
    lag = F.coalesce(F.lag("_d").over(Window.partitionBy(file).orderBy("ts_ns", "seq")), F.lit(0))
    out = counted.withColumn("dropped_before", (F.col("_d") - lag).cast("long")).drop("_ok", "_d")
    return out.withColumn("marker", F.when(F.col("dropped_before") > 0, F.concat(F.lit(f"{marker} "), F.col("dropped_before"), F.lit(" lines (rate limit)"))))
