"""Mixing sources to target weights: temperature mixing realised by budgeted block permutations.

A source with share p of the tokens gets weight p^a, normalised. The exponent a in [0, 1] (1 leaves the
shares, 0 makes them equal) is bisected: to the smallest that keeps every source within a limit of
repetitions, or to the one whose weights have a target entropy. The budget is the smallest that takes
every source at least once (or a number of tokens). A source with e epochs gives each document floor(e) times and
for the rest of its budget goes through its blocks in a permutation of its own: documents fall in 4096 blocks
by a hash, blocks are ordered by a hash of source, epoch and block, and taken until the budget is met; in the block
where it is met documents are taken in the order of their hash while the tokens before them are short of it.

Only sums a block move between tasks; one block of a source, 1/4096 of its rows, is the most that
meets in one window. The driver sees one row a source.

Defined cases: null texts have no tokens; a null source is a source of its own; a source without tokens is
taken once; rows that repeat an id are documents of their own, ordered alike; an empty table gives an empty
result; columns of the input other than the named ones come along through ``carry``.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spindrift.llm.common import staged

HEX = 3  # 16^3 blocks a source
BROADCAST_BYTES = 64 << 20


def weights(tokens: dict, exponent: float) -> dict:
    """Normalised p^a over the sources that have tokens."""
    total = sum(tokens.values())
    raw = {s: (n / total) ** exponent for s, n in tokens.items() if n > 0}
    norm = math.fsum(raw.values())
    return {s: x / norm for s, x in raw.items()}


def entropy(w: dict) -> float:
    """In bits."""
    return -math.fsum(x * math.log2(x) for x in w.values() if x > 0)


@dataclass
class Plan:
    exponent: float
    budget: float
    epochs: dict  # source -> how often its tokens are taken, a fraction


def _bisect(fits, rounds: int = 200) -> float:
    """Smallest exponent in [0, 1] that fits, for a test that larger ones pass as well."""
    if fits(0.0):
        return 0.0
    low, high = 0.0, 1.0
    for _ in range(rounds):
        mid = (low + high) / 2
        if mid in (low, high):
            break
        low, high = (low, mid) if fits(mid) else (mid, high)
    return high


def plan(tokens: dict, max_repeats: float | None = 4.0, target_entropy: float | None = None, budget: float | None = None) -> Plan:
    """Bisect the exponent for the repetition limit, or for the entropy (bits) if one is given; both: the larger exponent."""
    some = {s: n for s, n in tokens.items() if n > 0}
    if not some:
        return Plan(1.0, 0.0, {s: 1.0 for s in tokens})
    total = sum(some.values())

    def epochs(a: float) -> dict:
        w = weights(some, a)
        size = budget if budget is not None else max(some[s] / w[s] for s in some)
        return {s: w[s] * size / some[s] for s in some}

    found = []
    if target_entropy is not None:
        found.append(_bisect(lambda a: entropy(weights(some, a)) <= target_entropy + 1e-12))
    if max_repeats is not None:
        found.append(_bisect(lambda a: max(epochs(a).values()) <= max_repeats * (1 + 1e-12)))
    a = max(found, default=1.0)
    e = epochs(a)
    return Plan(a, budget if budget is not None else sum(e[s] * some[s] for s in some), {s: e.get(s, 1.0) for s in tokens} if total else {})


def mix_sources(
    df: DataFrame,
    id_col: str = "doc_id",
    source_col: str = "source",
    text_col: str = "text",
    carry: Sequence[str] = (),
    **limits,
) -> DataFrame:
    """A row for each time a document is taken: id, source, n_tokens, epoch (from 0), block and the ``carry`` columns.

    Tokens are runs of anything but white space.
    """
    spark = df.sparkSession
    source = F.coalesce(F.concat(F.lit("="), F.col(source_col)), F.lit("null"))
    rows = df.select(
        F.col(id_col).alias("_id"),
        source.alias("_s"),
        F.regexp_count(F.coalesce(F.col(text_col), F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long").alias("_n"),
        *[F.col(c).alias(f"_c_{c}") for c in carry],
    )
    rows = rows.withColumn("_h", F.md5(F.concat_ws(":", "_s", F.coalesce(F.col("_id").cast("string"), F.lit(""))).cast("binary"))).withColumn("_b", F.substring("_h", 1, HEX))
    blocks = staged(rows.groupBy("_s", "_b").agg(F.sum("_n").alias("_t")), "mix-blocks")
    tokens = {r._s: r.t for r in blocks.groupBy("_s").agg(F.sum("_t").alias("t")).collect()}  # one row a source
    made = plan(tokens, **limits)
    rest = {}
    for s, e in made.epochs.items():
        full = math.floor(e + 1e-9)
        rest[s] = (full, round((e - full) * tokens[s]) if e - full > 1e-9 else 0)
    budgets = spark.createDataFrame([(s, f, r) for s, (f, r) in sorted(rest.items())], "_s string, _full long, _rest long")

    order = Window.partitionBy("_s").orderBy(F.md5(F.concat_ws(":", "_s", F.col("_full").cast("string"), "_b").cast("binary")), "_b")
    placed = blocks.join(budgets, "_s").withColumn("_before", F.coalesce(F.sum("_t").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0).cast("long")))
    short = F.greatest(F.col("_rest") - F.col("_before"), F.lit(0).cast("long"))  # tokens that the block may still give
    table = staged(placed.select("_s", "_b", "_full", F.least(short, F.col("_t")).alias("_give"), ((short > 0) & (short < F.col("_t"))).alias("_cut"), (short > 0).alias("_in")), "mix-plan")

    # at most 4096 short rows a source, whatever the number of documents: broadcast while they are small, a plain join beyond
    size = len(tokens) * 16**HEX * (48 + max((len(s.encode()) for s in tokens), default=0))
    joined = rows.join(F.broadcast(table) if size <= BROADCAST_BYTES else table, ["_s", "_b"])
    inside = Window.partitionBy("_s", "_b").orderBy("_h", "_id", "_n").rowsBetween(Window.unboundedPreceding, -1)
    cut = joined.filter("_cut").withColumn("_last", F.coalesce(F.sum("_n").over(inside), F.lit(0).cast("long")) < F.col("_give"))
    done = joined.filter("not _cut").withColumn("_last", F.col("_in")).unionByName(cut)
    times = F.col("_full") + F.when(F.col("_last"), 1).otherwise(0)
    epochs = done.filter(times > 0).select("*", F.explode(F.sequence(F.lit(0).cast("long"), times - 1)).alias("epoch"))
    return epochs.select(
        F.col("_id").alias(id_col),
        F.when(F.col("_s") != "null", F.substring("_s", 2, 1 << 30)).alias(source_col),
        F.col("_n").alias("n_tokens"),
        "epoch",
        F.col("_b").alias("block"),
        *[F.col(f"_c_{c}").alias(c) for c in carry],
    )
