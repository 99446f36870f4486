"""What the operators share: the cluster's shared folder, staged tables and file access.

Intermediate tables go to the folder that the cluster names in ``spark.checkpoint.dir``; it must be
reachable from the driver and every executor. Only where it is unset and the master is local (tests, a laptop) a
temporary folder of this machine is used; on a cluster that is an error.
"""

from __future__ import annotations

import re
import tempfile
import uuid
from urllib.parse import urlparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The shared folder as a URI, without a trailing slash."""
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spindrift.shared.dir", None)
    if not where:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        where = "file://" + tempfile.mkdtemp(prefix="spindrift-")
        spark.conf.set("spindrift.shared.dir", where)
    return where.rstrip("/") if urlparse(where).scheme else "file://" + where.rstrip("/")


def fresh_dir(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = fresh_dir(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.staged_path = path
    return out


def drop_staged(df: DataFrame) -> None:
    """Delete a staged table that nothing reads any more."""
    path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df.staged_path)
    path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def text_or_empty(col) -> F.Column:
    return F.coalesce(F.col(col) if isinstance(col, str) else col, F.lit(""))


def filesystem(uri: str):
    """(pyarrow file system, path in it); any scheme that pyarrow knows."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def parallelism(spark: SparkSession) -> int:
    return max(2, spark.sparkContext.defaultParallelism)


def bounded_batches(spark: SparkSession) -> None:
    """Keep Arrow batches small, so that very long texts don't fill a worker."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 1000)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", 16 << 20)
