"""Container runtime logs: file paths, line formats, directory scans and load for tests."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# How log files are named and how their lines are laid out.
PATH = r"/([^/_]+)_([^/_]+)_([^/_]+)/([^/]+)/([0-9]+)\.log(\.[0-9]{8}-[0-9]{6})?(\.gz)?$"
TIME = r"^([0-9]{4}-[0-9]{2}-[0-9]{2}T[0-9]{2}:[0-9]{2}:[0-9]{2})(?:\.([0-9]{1,9})[0-9]*)?(Z|[+-][0-9]{2}:[0-9]{2})$"


def path_fields(path: Column) -> Column:
    """struct(ns, pod, uid, ctr, restart, rotated, gzip) of a log file's path; null if it is none."""
    part = lambda i: F.regexp_extract(path, PATH, i)
    fields = F.struct(
        part(1).alias("ns"),
        part(2).alias("pod"),
        part(3).alias("uid"),
        part(4).alias("ctr"),
        part(5).cast("int").alias("restart"),
        F.ltrim(part(6), F.lit(".")).alias("rotated"),
        (part(7) == ".gz").alias("gzip"),
    )
    return F.when(path.rlike(PATH), fields)


def time_ns(text: Column) -> Column:
    """Epoch nanoseconds of an RFC 3339 time; null if it is none."""
    zone = F.when(text.endswith("Z"), F.lit("Z")).otherwise(F.right(text, F.lit(6)))
    whole = F.concat(F.left(text, F.lit(19)), zone).try_cast("timestamp")
    fraction = F.substring(text, F.lit(21), F.greatest(F.length(text) - 20 - F.length(zone), F.lit(0)))
    return F.when(text.rlike(TIME), F.unix_seconds(whole) * 1_000_000_000 + F.rpad(F.left(fraction, F.lit(9)), 9, "0").cast("long"))


def _cri(p: Column, ts: Column) -> Column:
    """The same of a line's pieces (time, stream, tag and what follows) and its time, read."""
    at = lambda i: F.get(p, F.lit(i))
    return F.when(
        (F.size(p) >= 3) & (at(2) != "") & ts.isNotNull(),
        F.struct(ts.alias("ts_ns"), (at(1) == "stderr").alias("stderr"), at(2).startswith("P").alias("partial"), F.coalesce(at(3), F.lit("")).alias("msg")),
    )


def cri_fields(value: Column) -> Column:
    """struct(ts_ns, stderr, partial, msg) of ``<time> <stream> <tag> <message>``; null if malformed.

    Only the first three spaces part the line; any tag but an empty one will do, and one that begins with P is partial; a
    tag without a message is an empty message; the stream may be empty.
    """
    p = F.split(value, " ", 4)
    return _cri(p, time_ns(F.get(p, F.lit(0))))


def json_fields(value: Column) -> Column:
    """The same struct of a JSON runtime line (log, stream, time); partial unless the log ends in a line break."""
    j = F.from_json(value, "log string, stream string, time string")
    whole = j["log"].endswith("\n")
    msg = F.when(whole, F.left(j["log"], F.length(j["log"]) - 1)).otherwise(j["log"])
    ts = time_ns(j["time"])
    return F.when(
        value.startswith("{") & ts.isNotNull() & j["log"].isNotNull(),
        F.struct(ts.alias("ts_ns"), (j["stream"] == "stderr").alias("stderr"), (~whole).alias("partial"), msg.alias("msg")),
    )


def line_fields(value: Column) -> Column:
    """Either format, by the first character."""
    return F.when(value.startswith("{"), json_fields(value)).otherwise(cri_fields(value))


def parsed_lines(df: DataFrame, value: str = "value", malformed: bool = False) -> DataFrame:
    """``df`` with ts_ns, stderr, partial and msg of its lines in either format; malformed lines drop out, or stay with nulls.

    A line is cut once, its time read once and its fields are made once: a generator stands between them and whatever reads them,
    which the optimizer doesn't merge.
    """
    cut = df.withColumn("_p", F.split(value, " ", 4)).withColumn("_t", time_ns(F.get("_p", F.lit(0))))
    fields = F.when(F.col(value).startswith("{"), json_fields(F.col(value))).otherwise(_cri(F.col("_p"), F.col("_t")))
    made = cut.select(*df.columns, F.explode(F.array(fields)).alias("_l"))
    return (made if malformed else made.filter("_l is not null")).select(*df.columns, "_l.*")


def collected(df: DataFrame, include_ns: list[str] = (), exclude_ns: list[str] = (), exclude_ctr: list[str] = (), own_ctr: str | None = None) -> DataFrame:
    """Collection rules on ns and ctr, exact strings; ``own_ctr`` is the collector itself."""
    rule = F.lit(True)
    if include_ns:
        rule &= F.col("ns").isin(*include_ns)
    if exclude_ns:
        rule &= ~F.col("ns").isin(*exclude_ns)
    if exclude_ctr or own_ctr:
        rule &= ~F.col("ctr").isin(*exclude_ctr, *([own_ctr] if own_ctr else []))
    return df.filter(rule)


@contextmanager
def many_files(spark: SparkSession) -> Iterator[None]:
    """Inside, Spark lists folders with a few tasks a core instead of one a folder and packs small files by their size into tasks.

    Listing happens where a reader loads, packing where its rows are used.
    """
    fit = {"spark.sql.sources.parallelPartitionDiscovery.parallelism": str(4 * spark.sparkContext.defaultParallelism), "spark.sql.files.openCostInBytes": str(64 << 10)}
    before = {k: spark.conf.get(k) for k in fit}
    try:
        for k, v in fit.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def _log_files(spark: SparkSession, root: str | list[str], streaming: bool) -> DataFrame:
    reader = (spark.readStream if streaming else spark.read).schema("value string").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.log*")
    return reader.format("text").load(root)


def read_logs(spark: SparkSession, root: str, streaming: bool = False) -> DataFrame:
    """Parsed lines of every ``ns_pod_uid/ctr/N.log*`` under ``root``; .gz files are read as they are.

    A batch read backfills rotated files; the stream picks up new files as they land. ``path`` keys a
    container's stream of files in order of restart, rotation stamp and name.
    """
    raw = _log_files(spark, root, streaming).withColumn("path", F.col("_metadata.file_path"))
    at = parsed_lines(raw.withColumn("p", path_fields(F.col("path"))).filter("p is not null"))
    return at.select("p.ns", "p.pod", "p.uid", "p.ctr", "p.restart", "p.rotated", "p.gzip", "path", "ts_ns", "stderr", "partial", "msg")


def listed_files(spark: SparkSession, root: str) -> DataFrame:
    """(path, size) of the files that ``read_logs_at`` reads, without opening them."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.log*").load(root)
    return files.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_size").alias("size")).filter(F.col("path").rlike(PATH))


def read_logs_at(spark: SparkSession, root: str | list[str]) -> DataFrame:
    """``read_logs`` in batch, with off_start and off_end: where a line stands in its file's text, unpacked, line breaks of one byte.

    Lines keep the order of their splits and of their places in these; the running sum is a window over one file. They are
    parsed where they are read; malformed ones go after the sum. ``root`` may be a list of files.
    """
    raw = _log_files(spark, root, False).select("value", F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("_split"), F.monotonically_increasing_id().alias("_n"))
    order = Window.partitionBy("path").orderBy("_split", "_n").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    size = F.octet_length("value").cast("long") + 1
    fields = parsed_lines(raw.filter(F.col("path").rlike(PATH)).withColumn("_size", size), malformed=True).drop("value")
    placed = fields.withColumn("off_end", F.sum("_size").over(order)).withColumn("off_start", F.col("off_end") - F.col("_size"))
    at = placed.filter("ts_ns is not null").withColumn("p", path_fields(F.col("path")))
    return at.select("p.ns", "p.pod", "p.uid", "p.ctr", "p.restart", "p.rotated", "p.gzip", "path", "off_start", "off_end", "ts_ns", "stderr", "partial", "msg")


def write_files(df: DataFrame, root: str, *order: str) -> None:
    """Text files under ``root``: of each ``file``, a path below it, the rows' ``value`` as lines in the order of ``order``.

    Tasks write whole files, on any file system that pyarrow knows; nothing is done file by file on the driver. A file has a hidden
    name until it is whole, so a task that runs again puts the same files in place. Rows without a file or a value are no line.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, top = pyarrow.fs.FileSystem.from_uri(root)
        name, out, n = None, None, 0

        def close() -> None:
            if out is not None:
                out.close()
                fs.move(hidden, f"{top}/{name}")

        for batch in batches:
            runs, start = pc.run_end_encode(batch.column("file")), 0
            for file, end in zip(runs.values.to_pylist(), runs.run_ends.to_pylist()):
                if file != name:
                    close()
                    folder = f"{top}/{file}".rpartition("/")[0]
                    fs.create_dir(folder, recursive=True)
                    name, hidden, n = file, f"{folder}/.{uuid.uuid4().hex}", n + 1
                    out = fs.open_output_stream(hidden, compression=None)
                out.write("".join(f"{x}\n" for x in batch.column("value")[start:end].to_pylist()).encode())
                start = end
        close()
        yield pa.RecordBatch.from_pydict({"files": [n]})

    rows = df.filter("file is not null and value is not null").repartition("file").sortWithinPartitions("file", *order)
    rows.select("file", "value").mapInArrow(write, "files long").write.format("noop").mode("overwrite").save()


def file_order(rotated: Column) -> Column:
    """Backfill order of one container's files: rotated ones by stamp, the live file last."""
    return F.when(rotated == "", F.lit("~")).otherwise(rotated)


POD = "metadata struct<name:string,namespace:string,uid:string,labels:map<string,string>,annotations:map<string,string>,ownerReferences:array<struct<kind:string,name:string>>>"


def read_pods(spark: SparkSession, path: str) -> DataFrame:
    """A dump of pod objects, one JSON a line: uid, pod, ns, labels, annotations, owner_kind, owner_name."""
    m = F.col("metadata")
    return spark.read.schema(POD).json(path).select(
        m["uid"].alias("uid"), m["name"].alias("pod"), m["namespace"].alias("ns"), m["labels"].alias("labels"), m["annotations"].alias("annotations"),
        F.get(m["ownerReferences"], F.lit(0))["kind"].alias("owner_kind"), F.get(m["ownerReferences"], F.lit(0))["name"].alias("owner_name"),
    )


def synthetic(spark: SparkSession, rows_per_second: int = 1000, pods: int = 20) -> DataFrame:
    """An endless stream of runtime lines for load tests: path and value."""
    rate = spark.readStream.format("rate").option("rowsPerSecond", rows_per_second).load()
    n = F.col("value") % pods
    msg = F.to_json(F.struct(F.lit("info").alias("level"), F.col("value").alias("i"), F.concat(F.lit("request "), F.col("value")).alias("msg")))
    stamp = F.date_format("timestamp", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")
    return rate.select(F.concat(F.lit("/load_pod-"), n, F.lit("_uid-"), n, F.lit("/app/0.log")).alias("path"), F.concat(stamp, F.lit(" stdout F "), msg).alias("value"))
