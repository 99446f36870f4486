"""Data skipping for substring search: which files can have a literal, by the trigrams of their lines.

A literal's trigrams all stand in every line that has it, so a file that lacks one of them has no such line. Only
runs of token characters count, on both sides, lower-cased the same way as the filter does; a literal of fewer than
three token characters in a row, and a regex, decide nothing. Trigrams are hashed into ``BITS`` bits a file, so the side
table has a fixed size a file.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spindrift.functions.filters import literals

BITS = 1 << 16
WORD_BITS = 32_768  # what one bitmap row holds


def _runs(text: Column) -> Column:
    """Runs of token characters that have a trigram; text without other characters is cut in generated code."""
    return F.split(F.lower(text), r"[\x00-\x7f&&[^a-z0-9_]]+", -1)


def _position(gram: Column) -> Column:
    return F.pmod(F.xxhash64(gram), F.lit(BITS))


def _keys(file: str | Sequence[str]) -> list[str]:
    return [file] if isinstance(file, str) else list(file)


def trigram_table(lines: DataFrame, file: str | Sequence[str] = "file", text: str = "msg") -> DataFrame:
    """(file, bucket, bits): a bitmap of at most BITS bits a file; a file may be named by several columns.

    A row a trigram, in generated code; positions are made distinct by hash before the bitmaps, which take a sort.
    """
    keys = _keys(file)
    runs = lines.select(*keys, F.explode(_runs(F.col(text))).alias("r")).filter(F.length("r") >= 3)
    grams = runs.select(*keys, "r", F.explode(F.sequence(F.lit(1), F.length("r") - 2)).alias("i"))
    at = grams.select(*keys, _position(F.substring("r", F.col("i"), F.lit(3))).alias("p")).distinct()
    return at.groupBy(*keys, F.floor(F.col("p") / WORD_BITS).alias("bucket")).agg(F.bitmap_construct_agg(F.pmod("p", F.lit(WORD_BITS))).alias("bits"))


def literal_trigrams(word: str) -> list[str]:
    """Trigrams that any line with the literal must have."""
    return sorted({m[i : i + 3] for m in re.findall(r"(?:[a-z0-9_]|[^\x00-\x7f]){3,}", word) for i in range(len(m) - 2)})


def _judged(table: DataFrame, query: str, keys: list[str]) -> DataFrame | None:
    """The table's files and whether they have every trigram that the query asks for (``has``); None if it asks for none."""
    grams = sorted({g for w in literals(query) for g in literal_trigrams(w)})
    if not grams:
        return None
    spark: SparkSession = table.sparkSession
    wanted = spark.createDataFrame([(g,) for g in grams], "g string").select(_position(F.col("g")).alias("p")).distinct()
    wanted = wanted.select(F.floor(F.col("p") / WORD_BITS).alias("bucket"), F.pmod("p", F.lit(WORD_BITS)).alias("bit"))
    need = wanted.groupBy("bucket").agg(F.collect_list("bit").alias("bits_wanted"))
    n = F.lit(wanted.count())
    has = lambda bit: F.conv(F.hex(F.substring("bits", (F.floor(bit / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int").bitwiseAND(F.pow(F.lit(2), F.pmod(bit, F.lit(8))).cast("int")) != 0
    found = F.when(F.col("bits_wanted").isNull(), 0).otherwise(F.size(F.filter("bits_wanted", has)))
    hits = table.join(F.broadcast(need), "bucket", "left").select(*keys, found.alias("n"))  # need: a row a bucket
    return hits.groupBy(*keys).agg((F.sum("n") == n).alias("has"))


def candidates(table: DataFrame, query: str, file: str | Sequence[str] = "file") -> DataFrame:
    """Files that may have a matching line; all of them if the query decides nothing."""
    keys = _keys(file)
    judged = _judged(table, query, keys)
    return table.select(*keys).distinct() if judged is None else judged.filter("has").select(*keys)


def ruled_out(table: DataFrame, query: str, file: str | Sequence[str] = "file") -> DataFrame | None:
    """Files of the table that cannot have a matching line; None if the query decides nothing."""
    judged = _judged(table, query, _keys(file))
    return None if judged is None else judged.filter("not has").select(*_keys(file))


def without_ruled_out(lines: DataFrame, table: DataFrame, query: str, unit: Sequence[str]) -> DataFrame:
    """Lines of the units that the table does not rule out; units that it lacks, or whose name has a null, are read.

    The units of ``lines`` are read without any other column. Where they are partition columns and their list is
    small enough for Spark to broadcast, the directories of the rest are not opened.
    """
    out = ruled_out(table, query, unit)
    if out is None:
        return lines
    unnamed = F.lit(False)
    for c in unit:
        unnamed |= F.col(c).isNull()
    kept = lines.select(*unit).distinct().join(out, list(unit), "left_anti")
    return lines.join(kept, list(unit), "left_semi").unionByName(lines.filter(unnamed))


def read_candidates(spark: SparkSession, table: DataFrame, query: str, schema) -> DataFrame:
    """The lines of the files that a query cannot rule out; the driver holds the list of files, not their lines."""
    paths = [r.file for r in candidates(table, query).collect()]
    return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)
