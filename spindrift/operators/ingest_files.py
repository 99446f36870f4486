"""Log files to the store in one job: scan, parse, merge partial lines, join multi-line events, take each once, write.

The store itself says how far a file has been taken: the largest end offset of its rows is its cursor. A run reads what
files have, folds it and keeps the events that reach beyond their file's cursor; so a run again, after a crash or with
nothing new, adds nothing. An event at the end of a file is let go at the end of the run; lines that follow it later are an
event of their own.

Defined cases: malformed lines drop out; an empty directory writes nothing; a file that was rotated is a file of its own name;
one that shrank below its cursor gives nothing until it has grown beyond it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spindrift.functions.lines import day, truncated
from spindrift.operators.folds import join_multiline, merge_partial
from spindrift.sources.runtime import listed_files, many_files, path_fields, read_logs_at
from spindrift.streaming.ingest import store_batch

MOST_FILES = 10_000  # that are named to a reader one by one; beyond it reads the whole directory, with the same result
IDENTITY = ("ns", "pod", "uid", "ctr", "restart")


def events_of(lines: DataFrame, start_pattern: str | None, max_lines: int = 200, max_bytes: int = 256 << 10) -> DataFrame:
    """Rows of ``read_logs_at`` folded to events: path, off_start, off_end, n, ts_ns, stderr, msg and the file's identity.

    All folds go by path, one after the other, so one exchange serves them and nothing is computed twice; the identity, which the
    path gives, is read off it once an event.
    """
    whole = merge_partial(lines.withColumn("off", F.col("off_start")), "path", "off", max_bytes, "off_end")
    whole = whole.select("path", "off", "off_end", "ts_ns", "stderr", truncated(F.col("msg"), max_bytes).alias("msg"))
    starts = F.col("msg").rlike(start_pattern) if start_pattern else F.lit(True)
    grouped = join_multiline(whole, starts, "path", "off", max_lines, first=("ts_ns", "stderr"), last=("off_end",))
    after = F.lead("off").over(Window.partitionBy("path").orderBy("off"))
    placed = grouped.withColumn("off_end", F.coalesce(after, "off_end")).withColumn("p", path_fields(F.col("path")))
    return placed.select("path", F.col("off").alias("off_start"), "off_end", F.col("n").cast("long").alias("n"), "ts_ns", "stderr", "msg", *[f"p.{c}" for c in IDENTITY])


def cursors(spark: SparkSession, store: str) -> DataFrame | None:
    """(path, cursor) of a store; None while there is none."""
    path = spark._jvm.org.apache.hadoop.fs.Path(store)
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return None
    return spark.read.parquet(store).groupBy("path").agg(F.max("off_end").alias("cursor"))


def _with_news(spark: SparkSession, root: str, taken: DataFrame) -> str | list[str]:
    """The files that may reach beyond their cursors, or ``root`` if these are most or have names that a reader would not take as they are.

    No line begins at or after its file's size, so a file that is no larger than its cursor has nothing new; a packed one's size says nothing.
    """
    files = listed_files(spark, root).join(taken, "path", "left")
    old = F.coalesce(F.col("size") <= F.col("cursor"), F.lit(False)) & ~F.col("path").endswith(".gz")
    paths = [r.path for r in files.filter(~old).select("path").collect()]
    plain = len(paths) <= MOST_FILES and not any(set(p) & set("%*?[]{}\\") for p in paths)
    return paths if plain else root


def ingest_files(spark: SparkSession, root: str, store: str, batch_id: int, start_pattern: str | None = None, cluster: str = "", max_lines: int = 200, max_bytes: int = 256 << 10) -> None:
    """Take what is new under ``root`` into the store as one batch; files without news are not opened, lines before a file's cursor not folded again."""
    with many_files(spark):
        taken = cursors(spark, store)
        news = root if taken is None else _with_news(spark, root, taken)
        if not news:
            return
        lines = read_logs_at(spark, news)
        if taken is not None:
            lines = lines.join(taken, "path", "left").filter(F.col("off_start") >= F.coalesce("cursor", F.lit(0).cast("long"))).drop("cursor")
        events = events_of(lines, start_pattern, max_lines, max_bytes)
        store_batch(events.withColumns({"cluster": F.lit(cluster), "day": day(F.col("ts_ns"))}), batch_id, store)
