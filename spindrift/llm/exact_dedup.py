"""Exact dedup by progressive refinement: length, then prefix hash, then full hash.

Each level reads the texts once but hands only aggregates on: the keys that more than one row has are
folded into a bit table of fixed size, which the next level's scan probes. So only rows whose length
and prefix collide pay for a full hash, no text is ever shuffled, and what is broadcast does not grow
with the corpus. A false hit in a bit table costs one more full hash; it never changes the result.

Defined cases: a null text is empty; null ids never win against an id; rows that repeat an id and its
text are all marked alike (they count one by one in ``group_size``); an empty table gives an empty
result; other columns of the input are ignored unless named in ``carry``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spindrift.llm.common import staged, text_or_empty


def _bit(at: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(at, F.lit(64)).cast("int"))


def _bit_table(keys: DataFrame, key: Column, bits: int) -> DataFrame:
    """(word, mask) rows, at most bits/64 of them, with a bit set for each key."""
    at = F.pmod(key, F.lit(bits))
    return keys.groupBy(F.shiftright(at, 6).alias("_word")).agg(F.bit_or(_bit(at)).alias("_mask"))


def bits_for(keys: int, each: int = 16) -> int:
    """Bits of a table for so many keys, a power of two between 2^16 and 2^26 (2^20 rows); more keys only mean more false hits."""
    return 1 << min(26, max(16, (keys * each - 1).bit_length()))


def _probe(df: DataFrame, table: DataFrame, key: Column, bits: int, name: str) -> DataFrame:
    """``df`` with a boolean column: may the key be in the bit table?"""
    at = F.pmod(key, F.lit(bits))
    found = _bit(at).bitwiseAND(F.col("_mask")) != 0
    return (
        df.withColumn("_word", F.shiftright(at, 6))
        .join(F.broadcast(table), "_word", "left")
        .withColumn(name, F.coalesce(found, F.lit(False)))
        .drop("_word", "_mask")
    )


def exact_dedup(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    carry: Sequence[str] = (),
    prefix_chars: int = 256,
    bits: int | None = None,
) -> DataFrame:
    """id, keep_id, group_size, kept (and the ``carry`` columns) for each row of ``df``.

    Equal texts form a group; the row with the largest id stays. ``bits`` fixes the size of the
    broadcast bit tables (at most bits/64 rows); without it each level's table follows its number of keys.
    """
    text = text_or_empty(text_col)
    rows = df.select(F.col(id_col).alias("_id"), text.alias("_text"), *[F.col(c).alias(f"_c_{c}") for c in carry])
    by_length = rows.select(F.octet_length("_text").alias("_len"))
    lengths = staged(by_length.groupBy("_len").count().filter("count > 1").select("_len"), "lengths")
    bits1 = bits or bits_for(lengths.count())
    level1 = staged(_bit_table(lengths, F.xxhash64("_len"), bits1), "length-bits")

    sized = _probe(rows.withColumn("_len", F.octet_length("_text")), level1, F.xxhash64("_len"), bits1, "_hit1")
    prefix = F.xxhash64("_len", F.substring("_text", 1, prefix_chars))
    prefixes = staged(sized.filter("_hit1").select(prefix.alias("_p")).groupBy("_p").count().filter("count > 1").select("_p"), "prefixes")
    bits2 = bits or bits_for(prefixes.count())
    level2 = staged(_bit_table(prefixes, F.col("_p"), bits2), "prefix-bits")

    probed = _probe(sized.withColumn("_p", prefix), level2, F.col("_p"), bits2, "_hit2")
    narrow = staged(
        probed.select(
            "_id",
            F.when(F.col("_hit1") & F.col("_hit2"), F.sha2("_text", 256)).alias("_full"),
            *[f"_c_{c}" for c in carry],
        ),
        "fullhash",
    )
    groups = staged(
        narrow.filter("_full is not null")
        .groupBy(F.col("_full").alias("_key"))
        .agg(F.max("_id").alias("_keep"), F.count(F.lit(1)).alias("_n"))
        .filter("_n > 1"),
        "groups",
    )
    # rows without a full hash get a key of their own (without an id, one of 4096), so that they don't meet in one partition
    apart = F.coalesce(F.col("_id").cast("string"), F.concat(F.lit("n"), F.pmod(F.monotonically_increasing_id(), F.lit(4096)).cast("string")))
    keyed = narrow.withColumn("_key", F.coalesce("_full", F.concat(F.lit("~"), apart)))
    out = keyed.join(groups, "_key", "left")
    keep = F.when(F.col("_n").isNull(), F.col("_id")).otherwise(F.col("_keep"))
    return out.select(
        F.col("_id").alias(id_col),
        keep.alias("keep_id"),
        F.coalesce("_n", F.lit(1).cast("long")).alias("group_size"),
        F.coalesce(keep == F.col("_id"), F.col("_n").isNull() | F.col("_keep").isNull()).alias("kept"),
        *[F.col(f"_c_{c}").alias(c) for c in carry],
    )
