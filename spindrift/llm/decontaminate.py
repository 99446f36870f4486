"""Benchmark decontamination: SimHash of item-sized windows, multi-index Hamming search, exact verification.

All in DataFrame functions. A first pass over the texts marks the positions whose shingle is in a bit table of all
items' shingles; it says nothing of which item. Every size that an item has then gives windows: of all starts those
are kept that can hold the threshold's share of marked positions, and that end in a marked one or are the text's first
(a best window can be moved back, losing nothing, until it does). Equal windows are one from here on, wherever they
stand. Each window and each item gets a 64-bit SimHash of its shingles, and the multi-index finds the pairs: it
cuts fingerprints into five blocks of 13, 13, 13, 13 and 12 bits under the window's size; within 19 bits some block
differs in at most 3, so an item is stored under all values at up to 3 of each block and a window is looked up
under its own five. The candidates' weighted Jaccard similarity of shingles (weights: how often a shingle
occurs) decides.

Radius 19 is the mean distance at similarity 0.8 (9.7 bits) and more than three deviations. A lookup meets less than a
quarter of the items of the window's own size.

Defined cases: null and empty texts and items without words match nothing; an item of fewer words than a
shingle is one shingle, its whole word sequence; a text shorter than an item is one window; words are runs of
letters and digits, lower-cased; rows that repeat an id are reported by their own texts and collapse if equal; rows
with a null id are reported under a null id; empty tables give an empty result; other columns are ignored.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spindrift.llm.common import staged, text_or_empty
from spindrift.llm.exact_dedup import _bit_table, _probe, bits_for

SHINGLE = 5
RADIUS = 19
BLOCKS = (13, 13, 13, 13, 12)
NEAR = RADIUS // len(BLOCKS)


def words(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+", -1), lambda w: w != "")


def _raw_words(text: Column) -> Column:
    """Like ``words`` with an empty first or last entry possible: split alone stays in generated code."""
    return F.split(F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " ")), " ", -1)


def shingles(w: Column, k: Column | int) -> Column:
    """Hashes of all k-word shingles of a word array; empty if it has fewer words."""
    k = F.lit(k) if isinstance(k, int) else k
    n = F.size(w) - k + 1
    return F.when(n > 0, F.transform(F.sequence(F.lit(1), n), lambda i: F.xxhash64(F.slice(w, i, k)))).otherwise(F.array().cast("array<bigint>"))


def simhash(h: Column) -> Column:
    """64-bit SimHash of an array of hashes, as a signed long."""

    def bit(b: Column) -> Column:
        ones = F.size(F.filter(h, lambda x: F.call_function("shiftright", x, b).bitwiseAND(F.lit(1).cast("long")) == 1))
        return F.when(ones * 2 > F.size(h), F.call_function("shiftleft", F.lit(1).cast("long"), b)).otherwise(F.lit(0).cast("long"))

    return F.aggregate(F.transform(F.sequence(F.lit(0), F.lit(63)), bit), F.lit(0).cast("long"), lambda a, x: a.bitwiseOR(x))


def weighted_jaccard(a: Column, b: Column) -> Column:
    """Sum of minima over sum of maxima of the two arrays' multiplicities."""

    def numbered(x: Column) -> Column:
        s = F.array_sort(x)
        return F.transform(s, lambda v, i: F.struct(v.alias("v"), (i - F.array_position(s, v)).alias("n")))

    plain = (F.size(F.array_distinct(a)) == F.size(a)) & (F.size(F.array_distinct(b)) == F.size(b))
    both = F.when(plain, F.size(F.array_intersect(a, b))).otherwise(F.size(F.array_intersect(numbered(a), numbered(b))))
    return both / (F.size(a) + F.size(b) - both)


def _masks(width: int, most: int) -> list[int]:
    return [sum(1 << i for i in c) for n in range(most + 1) for c in combinations(range(width), n)]


def _blocks(fp: str, most: int) -> Column:
    """All (block, value) keys within ``most`` bits of the fingerprint's blocks."""
    def one(i: int, width: int) -> Column:
        own = F.shiftrightunsigned(F.col(fp), sum(BLOCKS[:i])).bitwiseAND(F.lit((1 << width) - 1).cast("long"))
        return F.transform(F.array(*[F.lit(m).cast("long") for m in _masks(width, most)]), lambda m: own.bitwiseXOR(m) + F.lit(i << 16))

    return F.concat(*[one(i, width) for i, width in enumerate(BLOCKS)])


def _need(n: Column, k: Column | int, length: Column, threshold: float) -> Column:
    """Fewest shingles that a window of ``length`` words in a text of n must share with an item of its size."""
    size = length - k + 1
    return F.greatest(F.lit(1), F.ceil((size + F.least(size, n - k + 1)) * (threshold / (1 + threshold)) - 1e-6)).cast("int")


def _starts(k: int, threshold: float) -> Column:
    """Starts of the windows of ``len`` words whose last shingle is at one of the marked positions _p, and of the text's first window,
    without those that hold too few of the positions to be similar enough (each position is at most one shared shingle)."""
    p, span, need = F.col("_p"), F.col("len") - k, F.col("_need")
    last = F.transform(p, lambda x, i: F.when(F.get(p, i - need + 1) >= x - span, F.greatest(F.lit(0), x - span)))
    first = F.when(F.get(p, need - 1) <= span, F.lit(0))
    return F.array_distinct(F.filter(F.concat(last, F.array(first)), lambda s: s.isNotNull()))


def item_index(items: DataFrame, item_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """Each item with words: item_id, len, k, sh (shingle hashes), fp; staged."""
    w = items.select(F.col(item_col).alias("item_id"), words(text_or_empty(text_col)).alias("w")).filter(F.size("w") > 0)
    k = F.least(F.lit(SHINGLE), F.size("w"))
    out = w.select("item_id", F.size("w").alias("len"), k.alias("k"), shingles(F.col("w"), k).alias("sh"))
    return staged(out.withColumn("fp", simhash(F.col("sh"))).distinct(), "benchmark-items")


def windows_of(docs: DataFrame, index: DataFrame, text_col: str, threshold: float) -> DataFrame:
    """(_ck, _n, _wins): the windows (k, len, start) of each distinct text that has any; staged. _ck and _n (a hash and the number of words) name a text."""
    marks = index.select(F.explode("sh").alias("h")).distinct()
    bits = bits_for(marks.count(), 512)
    table = staged(_bit_table(marks, F.col("h"), bits), "benchmark-bits")
    lengths: dict[int, list[int]] = {}
    for r in index.select("k", "len").distinct().collect():  # the items' sizes, two numbers each
        lengths.setdefault(r.k, []).append(r.len)

    out = None
    for k in sorted(lengths) or [SHINGLE]:
        sizes = F.array(*[F.lit(n) for n in sorted(lengths.get(k, []))]).cast("array<int>")
        w = docs.select(F.xxhash64(text_or_empty(text_col)).alias("_ck"), _raw_words(text_or_empty(text_col)).alias("_w"))
        at = w.filter(F.size("_w") >= k).select("_ck", F.size("_w").alias("_n"), "_w", F.explode(F.sequence(F.lit(0), F.size("_w") - k)).alias("_at"))
        hashed = at.select("_ck", "_n", "_at", F.xxhash64(*[F.get("_w", F.col("_at") + i) for i in range(k)]).alias("h"))
        marked = _probe(hashed, table, F.col("h"), bits, "_hit").filter("_hit").groupBy("_ck", "_n").agg(F.array_sort(F.collect_set("_at")).alias("_p"))
        sized = marked.select("*", F.explode(sizes).alias("len")).withColumn("_need", _need(F.col("_n"), k, F.col("len"), threshold)).filter(F.size("_p") >= F.col("_need"))
        found = sized.select("_ck", "_n", F.lit(k).alias("k"), "len", F.explode(_starts(k, threshold)).alias("start"))
        out = found if out is None else out.unionByName(found)
    return staged(out.groupBy("_ck", "_n").agg(F.collect_list(F.struct("k", "len", "start")).alias("_wins")), "windows")


def near_fingerprints(items: DataFrame, windows: DataFrame) -> DataFrame:
    """(len, k, fp, wfp): the pairs of an item's and a window's fingerprint of one size within RADIUS bits, by the multi-index."""
    item_side = items.select("len", "k", "fp").distinct().select("*", F.explode(_blocks("fp", NEAR)).alias("key"))
    window_side = windows.select("len", "k", F.col("fp").alias("wfp")).distinct().select("*", F.explode(_blocks("wfp", 0)).alias("key"))
    met = window_side.join(staged(item_side, "item-blocks"), ["len", "k", "key"])
    return met.filter(F.bit_count(F.col("fp").bitwiseXOR(F.col("wfp"))) <= RADIUS).select("len", "k", "fp", "wfp").distinct()


def contaminated(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.8) -> DataFrame:
    """(id, item_id, start, similarity) of each document and item of which some window is similar enough; start is the best window's first word."""
    index = item_index(items)
    windows = windows_of(docs, index, text_col, threshold)

    # the texts that have a window; a bit table keeps all others out of the shuffle
    rows = docs.select(F.col(id_col).alias("_id"), text_or_empty(text_col).alias("_text")).withColumn("_ck", F.xxhash64("_text"))
    bits = bits_for(windows.count(), 64)
    table = staged(_bit_table(windows, F.col("_ck"), bits), "window-bits")
    near = staged(_probe(rows, table, F.col("_ck"), bits, "_hit").filter("_hit").select("_id", "_ck", _raw_words(F.col("_text")).alias("_w")).withColumn("_n", F.size("_w")), "window-texts")
    texts = near.dropDuplicates(["_ck", "_n"]).select("_ck", "_n", "_w")

    cut = lambda w: F.slice("_w", w["start"] + 1, w["len"])
    told = texts.join(windows, ["_ck", "_n"]).select("_ck", "_n", F.explode(F.transform("_wins", lambda w: F.struct(w["k"].alias("k"), w["len"].alias("len"), w["start"].alias("start"), F.xxhash64(cut(w)).alias("wkey")))).alias("w"))
    placed = staged(told.select("_ck", "_n", "w.*"), "window-places")
    one = placed.dropDuplicates(["k", "len", "wkey"]).groupBy("_ck", "_n").agg(F.collect_list(F.struct("k", "len", "start", "wkey")).alias("_wins"))
    shingled = texts.join(one, ["_ck", "_n"]).select(F.explode(F.transform("_wins", lambda w: F.struct(w["k"].alias("k"), w["len"].alias("len"), w["wkey"].alias("wkey"), shingles(cut(w), w["k"]).alias("sh")))).alias("w"))
    prints = staged(shingled.select("w.*").filter(F.size("sh") > 0).withColumn("fp", simhash(F.col("sh"))), "window-prints")

    pairs = staged(near_fingerprints(index, prints), "fp-pairs")
    cand = prints.withColumnRenamed("fp", "wfp").join(pairs, ["len", "k", "wfp"]).join(index.select("item_id", "len", "k", "fp", F.col("sh").alias("ish")), ["len", "k", "fp"])
    exact = cand.select("len", "k", "wkey", "item_id", weighted_jaccard(F.col("sh"), F.col("ish")).alias("similarity")).filter(F.col("similarity") >= threshold)
    best = placed.join(staged(exact, "window-items"), ["len", "k", "wkey"]).groupBy("_ck", "_n", "item_id").agg(
        F.max("similarity").alias("similarity"), F.min_by("start", F.struct(-F.col("similarity"), F.col("start"))).alias("start")
    )
    out = near.select("_id", "_ck", "_n").join(best, ["_ck", "_n"]).select(F.col("_id").alias(id_col), "item_id", "start", "similarity")
    return out.distinct()
