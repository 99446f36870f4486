"""Pushed batches: text of section headers and their entries, one JSON a line."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spindrift.functions.lines import stream_key, truncated

HEADER = "k string, f string, o array<bigint>, r int, end boolean, l map<string,string>"
ENTRY = "t bigint, s string, m string"


def is_header(line: Column) -> Column:
    return line.startswith('{"k"')


def entries(bodies: DataFrame, body_col: str = "body", text_col: str = "text", max_bytes: int = 256 << 10) -> DataFrame:
    """One row an entry, with the fields of the section that it stands in.

    A header holds for the lines after it; entries before any header and lines of at most one byte do not
    count. Lines go by their place in the body, which the explode gives, so no body is sorted.
    """
    lines = bodies.select(F.col(body_col).alias("body"), F.posexplode(F.split(text_col, "\n")).alias("pos", "line"))
    order = Window.partitionBy("body").orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    head = F.when(is_header(F.col("line")), F.struct("pos", F.col("line").alias("h")))
    carried = lines.withColumn("head", F.last(head, ignorenulls=True).over(order))
    kept = carried.filter(~is_header(F.col("line")) & (F.octet_length("line") > 1) & F.col("head").isNotNull())
    parsed = kept.withColumn("h", F.from_json("head.h", HEADER)).withColumn("e", F.from_json("line", ENTRY)).withColumn("key", stream_key(F.col("h.k")))
    return parsed.filter("key is not null and e.t is not null").select(
        "body", "pos", F.col("head.pos").alias("section"), "key.ns", "key.pod", "key.uid", "key.ctr",
        F.col("h.f").alias("file"), F.get("h.o", F.lit(0)).alias("off_start"), F.get("h.o", F.lit(1)).alias("off_end"),
        F.coalesce("h.r", F.lit(0)).alias("restart"), F.coalesce("h.end", F.lit(False)).alias("ended"), F.col("h.l").alias("labels"),
        F.col("e.t").alias("ts_ns"), (F.col("e.s") == "e").alias("stderr"), truncated(F.coalesce("e.m", F.lit("")), max_bytes).alias("msg"),
    )


def valid_cluster(name: Column) -> Column:
    return F.coalesce(name.rlike(r"^[^/\\]+$"), F.lit(False))


def encode(sections: DataFrame) -> DataFrame:
    """Bodies of sections with entries: columns body, section, k, f, o, r, end, l, entries -> body, text.

    Sections keep the order of their first appearance.
    """
    head = F.to_json(F.struct("k", "f", "o", "r", F.when(F.col("end"), F.lit(True)).alias("end"), "l"))
    lines = F.array_join(F.concat(F.array(head), F.transform("entries", lambda e: F.to_json(e))), "\n")
    per = sections.select("body", F.struct("section", lines.alias("lines")).alias("x"))
    return per.groupBy("body").agg(F.array_join(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["lines"]), "\n").alias("text"))
