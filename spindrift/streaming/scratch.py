"""Folders for a query's own tables, on the cluster's shared storage."""

from __future__ import annotations

import tempfile
import uuid
from urllib.parse import urlparse

from pyspark.sql import SparkSession


def fresh(spark: SparkSession, name: str) -> str:
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spindrift.scratch.dir", None)
    if not where:
        where = tempfile.mkdtemp(prefix="spindrift-")
        spark.conf.set("spindrift.scratch.dir", where)
    return f"{where if urlparse(where).scheme else 'file://' + where}".rstrip("/") + f"/{name}-{uuid.uuid4().hex}"
