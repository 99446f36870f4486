"""Streaming ingest: exactly-once by cursors, partial lines, multi-line events, an idempotent store.

State is keyed by stream and file, so keys spread evenly and a file's rows keep their order: within a micro-batch they
are sorted by offset before the state sees them. No watermark: a line of any age is taken. State of files that
are silent for long goes by a processing-time timeout where one is given; it asks for empty batches for as long
as the query lives, so runs over what is there (``collect_stream``) must be without one.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import StructType


def _timeout(ms: int | None) -> str:
    return GroupStateTimeout.NoTimeout if ms is None else GroupStateTimeout.ProcessingTimeTimeout


def _expire(state: GroupState, ms: int | None) -> None:
    if ms is not None:
        state.setTimeoutDuration(ms)


def exactly_once(sections: DataFrame, ttl_ms: int | None = None) -> DataFrame:
    """Sections (sid, file, seq, off_start, off_end, ...) that reach beyond what was accepted before; whole if they overlap."""
    schema: StructType = sections.schema

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        cursor = state.get[0] if state.exists else 0
        rows = pd.concat(list(batches)).sort_values(["off_start", "seq"] if "off_start" in schema.names else ["seq"], kind="stable")
        before = rows["off_end"].cummax().shift(fill_value=cursor).clip(lower=cursor)
        state.update((int(max(cursor, rows["off_end"].max())),))
        _expire(state, ttl_ms)
        yield rows[rows["off_end"] > before]

    return sections.groupBy("sid", "file").applyInPandasWithState(step, schema, "cursor long", "append", _timeout(ttl_ms))


LINE = "file string, off long, n long, msg string"


def whole_lines(pieces: DataFrame, max_bytes: int = 1 << 20, quiet_ms: int | None = None) -> DataFrame:
    """Pieces (file, off, partial, msg) joined to lines; what is pending stays in the state."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        off, n, text = state.get if state.exists else (-1, 0, "")
        out = []
        if state.hasTimedOut:
            state.remove()
            yield pd.DataFrame([(key[0], off, n, text)], columns=["file", "off", "n", "msg"])
            return
        for r in pd.concat(list(batches)).sort_values("off").itertuples():
            off, n, text = (off, n + 1, text + r.msg) if n else (r.off, 1, r.msg)
            if not r.partial or n > 1 and len(text.encode()) >= max_bytes:
                out.append((key[0], off, n, text))
                n, text = 0, ""
        if n:
            state.update((int(off), int(n), text))
            _expire(state, quiet_ms)
        elif state.exists:
            state.remove()
        yield pd.DataFrame(out, columns=["file", "off", "n", "msg"])

    return pieces.groupBy("file").applyInPandasWithState(step, LINE, "off long, n long, msg string", "append", _timeout(quiet_ms))


def multiline_events(lines: DataFrame, start_pattern: str, max_lines: int = 200, quiet_ms: int | None = 2000) -> DataFrame:
    """Lines (file, off, msg) joined to events; an open event closes at the next start, at ``max_lines`` or after ``quiet_ms``."""
    import re

    starts = re.compile(start_pattern)

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        off, n, text = state.get if state.exists else (-1, 0, "")
        if state.hasTimedOut:
            state.remove()
            yield pd.DataFrame([(key[0], off, n, text)], columns=["file", "off", "n", "msg"])
            return
        out = []
        for r in pd.concat(list(batches)).sort_values("off").itertuples():
            if n and (n >= max_lines or starts.search(r.msg)):
                out.append((key[0], off, n, text))
                n = 0
            off, n, text = (off, n + 1, f"{text}\n{r.msg}") if n else (r.off, 1, r.msg)
        state.update((int(off), int(n), text))
        _expire(state, quiet_ms)
        yield pd.DataFrame(out, columns=["file", "off", "n", "msg"])

    return lines.groupBy("file").applyInPandasWithState(step, LINE, "off long, n long, msg string", "append", _timeout(quiet_ms))


def limited(events: DataFrame, per_second: float, by: str = "cluster", burst: float = 2.0) -> DataFrame:
    """A token bucket of bytes for each key on event time: column ``allowed``; the balance may go below zero once."""
    schema = StructType.fromDDL(", ".join(f"{f.name} {f.dataType.simpleString()}" for f in events.schema) + ", allowed boolean")

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        tokens, last = state.get if state.exists else (float(per_second), None)
        rows = pd.concat(list(batches)).sort_values(["ts_ns", "seq"])
        ok = []
        for ts, size in zip(rows["ts_ns"], rows["bytes"]):
            tokens = min(per_second * burst, tokens + (max(0, ts - last) / 1e9 * per_second if last is not None else 0.0))
            last = max(ts, last or ts)
            ok.append(tokens >= 0)
            tokens -= size if tokens >= 0 else 0
        state.update((float(tokens), int(last)))
        yield rows.assign(allowed=ok)

    return events.groupBy(by).applyInPandasWithState(step, schema, "tokens double, last long", "append", GroupStateTimeout.NoTimeout)


def store_batch(batch: DataFrame, batch_id: int, root: str) -> None:
    """Write a micro-batch as day/cluster/ns partitions sorted for range reads; a batch that runs again replaces itself.

    The day comes first, so that listings and pruning see days, and the batch last; ``compact_day`` merges a day's batches.
    """
    out = batch.withColumn("batch", F.lit(batch_id))
    spread = out.repartition("day", "cluster", "ns", F.pmod(F.xxhash64("pod", "uid", "ctr"), F.lit(16))).sortWithinPartitions("day", "cluster", "ns", "pod", "uid", "ctr", "ts_ns")
    spread.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("compression", "zstd").partitionBy("day", "cluster", "ns", "batch").parquet(root)


def compact_day(spark: SparkSession, root: str, day: str, max_file_rows: int = 5_000_000) -> int:
    """Merge what the batches of a day have written into few sorted files under batch -1; returns how many folders it replaced.

    To be run when nothing writes the day any more. The merged files are written beside the table first and moved in before the
    old ones go, so a crash leaves rows twice at worst, never lost; a run after it, with ``batch`` and the rows equal, removes them.
    """
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/day={day}")
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    old = [x.getPath() for x in fs.globStatus(spark._jvm.org.apache.hadoop.fs.Path(f"{root}/day={day}/*/*/batch=*")) or []]
    if len(old) < 2:
        return 0
    rows = spark.read.option("basePath", root).parquet(*[p.toString() for p in old]).drop("batch", "day").distinct()
    fresh = f"{root}/_compact-{day}-{uuid.uuid4().hex}"
    spread = rows.repartition("cluster", "ns").sortWithinPartitions("cluster", "ns", "pod", "uid", "ctr", "ts_ns")
    spread.write.option("compression", "zstd").option("maxRecordsPerFile", max_file_rows).partitionBy("cluster", "ns").parquet(fresh)
    made = fs.globStatus(spark._jvm.org.apache.hadoop.fs.Path(f"{fresh}/*/*"))
    for x in made:
        parts = x.getPath().toString().split("/")[-2:]
        to = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/day={day}/{'/'.join(parts)}/batch=-{uuid.uuid4().int % 10**9 + 1}")
        fs.rename(x.getPath(), to)
    for p in old:
        fs.delete(p, True)
    fs.delete(spark._jvm.org.apache.hadoop.fs.Path(fresh), True)
    return len(old)


def run_to_store(stream: DataFrame, root: str, checkpoint: str, once: bool = True):
    """Start the query that keeps the store; with ``once`` it takes what is there and ends."""
    writer = stream.writeStream.foreachBatch(lambda df, i: store_batch(df, i, root)).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime="1 second")).start()


def open_groups(spark: SparkSession, checkpoint: str) -> DataFrame:
    """(file, off, n, msg) that the state of ``whole_lines`` or ``multiline_events`` still holds, read from its checkpoint."""
    state = spark.read.format("statestore").load(checkpoint)
    return state.select(F.col("key.file").alias("file"), "value.groupState.off", "value.groupState.n", "value.groupState.msg").filter("n > 0")


def collect_stream(stream: DataFrame, root: str, checkpoint: str, with_open: bool = False) -> DataFrame:
    """Run a stream over what is there and return all it put out, as a batch table; ``with_open`` adds the groups still open at the end."""
    spark: SparkSession = stream.sparkSession

    def sink(df: DataFrame, i: int) -> None:
        df.write.mode("overwrite").parquet(f"{root}/batch={i}")

    stream.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    out = spark.read.schema(stream.schema).option("recursiveFileLookup", "true").parquet(root)
    return out.unionByName(open_groups(spark, checkpoint)) if with_open else out
