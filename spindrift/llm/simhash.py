"""SimHash near-dedup with a Gray-order hierarchical index.

Fingerprints: one bit a position, set where more than half of the shingle hashes (XXH64, seed 42) set it.
Equal fingerprints collapse first, so copies cost one entry however many they are.

Search: the distinct fingerprints are sorted by Gray rank and indexed as a tree: a node keeps the bits that its whole
group shares as a masked pattern, without those its parent has already, so a search adds up differences on its way down
and drops a whole group as soon as they pass the radius. Groups whose members cannot differ by more than the radius are
linked whole. A coarse key routes: of four blocks of ``r`` bits, disjoint, one is equal within 3 differing bits, so each
fingerprint goes into four tables by one block each; r grows with the corpus (0 to 16), so that a key keeps thousands
of members and the trees below it do the search. A key of too many members is cut at quantiles of the Gray rank into
segments of bounded size; a segment is a tree and is searched with its own members, and, where a key has several, with those
members of the key's other segments whose differences from the segment's root pattern stay within the radius. So a
hot key is many tasks. A segment hands on a spanning forest, never its pairs.

Components: large-star/small-star rounds over the forests, each staged in the shared folder.

Defined cases: null and empty texts have fingerprint zero and link like any other; null ids join a
component but never name it (all null: null); rows that repeat an id count as one vertex each; an empty table
gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from spindrift.llm.common import drop_staged, parallelism, staged, text_or_empty

RADIUS = 3
FAN = 4
FRONTIER = 1 << 18
SEGMENT = 1 << 17  # members of a tree at most
KEEP = 1 << 12  # members that a routing key should keep
_WEIGHTS = np.uint64(1) << np.arange(64, dtype=np.uint64)


def fingerprint(text: str, shingle: int = 3) -> int:
    """64-bit SimHash of the text's word shingles; A-Z lower-cased, words of ASCII white space, repeats included."""
    from xxhash import xxh64_intdigest

    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= shingle:
        return xxh64_intdigest(joined, 42)
    sizes = np.fromiter(map(len, words), np.int64, len(words)) + 1
    ends = np.cumsum(sizes) - 1
    starts = ends - sizes + 1
    n = len(words) - shingle + 1
    spans = zip(starts[:n].tolist(), ends[shingle - 1 :].tolist())
    h = np.fromiter((xxh64_intdigest(joined[a:b], 42) for a, b in spans), np.uint64, n)
    ones = np.zeros(64, np.int64)
    for i in range(0, n, 4096):
        bits = np.unpackbits(h[i : i + 4096].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return int(_WEIGHTS[ones * 2 > n].sum(dtype=np.uint64))


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, carry: tuple[str, ...] = ()) -> DataFrame:
    """id, fp (the fingerprint as a signed long) and the ``carry`` columns of every row."""
    names = [f"_k{i}" for i in range(1 + len(carry))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = np.array([fingerprint(t, shingle) for t in b["_text"].to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*[b[n] for n in names], pa.array(fp)], names=[*names, "fp"])

    rows = df.select(*[F.col(c).alias(n) for c, n in zip((id_col, *carry), names)], text_or_empty(text_col).alias("_text"))
    kinds = StructType([*rows.schema.fields[:-1], StructField("fp", LongType())])
    got = rows.mapInArrow(run, kinds)
    return got.select(F.col("_k0").alias(id_col), "fp", *[F.col(n).alias(c) for c, n in zip(carry, names[1:])])


def gray_rank(fp: np.ndarray) -> np.ndarray:
    """Position of each word in the binary reflected Gray sequence."""
    r = fp.copy()
    for s in (1, 2, 4, 8, 16, 32):
        r ^= r >> np.uint64(s)
    return r


class GrayIndex:
    """Index of sorted (key, Gray rank) fingerprints; the roots are the keys' groups."""

    def __init__(self, key: np.ndarray, fp: np.ndarray):
        self.fp = fp
        level = {"start": np.arange(len(fp)), "end": np.arange(1, len(fp) + 1), "key": key, "mask": np.full(len(fp), ~np.uint64(0)), "pattern": fp}
        self.levels = [level]
        while len(level["key"]) > len(np.unique(level["key"])):
            level = self._group(level)
            self.levels.append(level)
        self.levels.reverse()  # roots first
        for up, low in zip(self.levels, self.levels[1:]):
            owner = np.repeat(np.arange(len(up["key"])), up["kids"])
            low["rest"] = low["mask"] & ~up["mask"][owner]
            low["free"] = 64 - np.bitwise_count(low["mask"]).astype(np.int64)
        self.levels[0]["rest"] = self.levels[0]["mask"]
        self.levels[0]["free"] = 64 - np.bitwise_count(self.levels[0]["mask"]).astype(np.int64)
        self.visited = np.zeros(len(self.levels), np.int64)  # nodes compared on each level, roots first
        self.pruned = np.zeros(len(self.levels), np.int64)  # of these, dropped with all that is below

    @staticmethod
    def _group(low: dict) -> dict:
        """Runs of up to FAN neighbours of one key; a group's mask has the bits that all of it share."""
        key = low["key"]
        first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        place = np.arange(len(key)) - np.repeat(first, np.diff(np.r_[first, len(key)]))
        at = np.flatnonzero(place % FAN == 0)
        both = np.bitwise_and.reduceat(low["pattern"] & low["mask"], at)
        none = np.bitwise_and.reduceat(~low["pattern"] & low["mask"], at)
        return {
            "key": key[at],
            "first": at,
            "kids": np.diff(np.r_[at, len(key)]),
            "start": low["start"][at],
            "end": low["end"][np.r_[at[1:], len(key)] - 1],
            "mask": both | none,
            "pattern": both,
        }

    def links(self, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
        """Spanning links (positions a, b) of the graph 'within radius under one key'.

        Queries go in waves by their place in the group (0, 1, 2-3, 4-7, ...), so that a wave can skip
        every node that earlier waves have linked to the query already.
        """
        parent = np.arange(len(self.fp))
        top = self.levels[0]
        size = top["end"] - top["start"]
        group = np.repeat(np.arange(len(size)), size)
        place = np.arange(len(self.fp)) - top["start"][group]
        wave = np.where(place == 0, 0, np.floor(np.log2(np.maximum(place, 1))).astype(np.int64) + 1)
        open_ = size[group] > 1
        for w in range(int(wave[open_].max(initial=-1)) + 1):
            q = np.flatnonzero(open_ & (wave == w))
            root = _roots(parent)
            one = [_uniform(root, level["start"]) for level in self.levels]
            self._search(q, group[q], radius, parent, root.copy(), one)
        self.parent = parent
        root = _roots(parent)
        at = np.flatnonzero(root != np.arange(len(root)))
        return at, root[at]

    def _search(self, q: np.ndarray, node: np.ndarray, radius: int, parent: np.ndarray, root: np.ndarray, one: list[np.ndarray]) -> None:
        """Walk down from the roots with the differences so far, depth first in pieces: a piece opens into at most about FRONTIER nodes."""
        stack = [(0, q, node, np.zeros(len(q), np.int64))]
        while stack:
            depth, q, node, acc = stack.pop()
            level = self.levels[depth]
            if depth:  # open the nodes of the level above; what waits on the stack is not opened yet
                up = self.levels[depth - 1]
                kids = up["kids"][node]
                node = np.repeat(up["first"][node] - np.r_[0, np.cumsum(kids)[:-1]], kids) + np.arange(kids.sum())
                q, acc = np.repeat(q, kids), np.repeat(acc, kids)
            acc = acc + np.bitwise_count((self.fp[q] ^ level["pattern"][node]) & level["rest"][node])
            self.visited[depth] += len(q)
            self.pruned[depth] += int((acc > radius).sum())
            near = (acc <= radius) & (level["end"][node] > q + 1) & (one[depth][node] != root[q])  # a pair is met once, from its first
            q, node, acc = q[near], node[near], acc[near]
            whole = acc + level["free"][node] <= radius  # the group cannot differ by more: take it whole
            if whole.any():
                self._take(q[whole], node[whole], level, parent)
                q, node, acc = q[~whole], node[~whole], acc[~whole]
            if depth < len(self.levels) - 1:
                step = max(1, FRONTIER // FAN)
                stack += [(depth + 1, q[i : i + step], node[i : i + step], acc[i : i + step]) for i in range(0, len(q), step)]

    def matches(self, fp: np.ndarray, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
        """For queries from outside an index of one key: a spanning set of (query, position) links, in order of the query.

        A query links to the first member of each component it meets; its own components are given by ``links``.
        """
        root = _roots(self.parent) if hasattr(self, "parent") else np.arange(len(self.fp))
        one = [_uniform(root, level["start"]) for level in self.levels]
        out = []
        step = max(1, FRONTIER // FAN)
        stack = [(0, np.arange(i, min(i + step, len(fp))), np.zeros(min(step, len(fp) - i), np.int64), np.zeros(min(step, len(fp) - i), np.int64)) for i in range(0, len(fp), step)]
        while stack:
            depth, q, node, acc = stack.pop()
            level = self.levels[depth]
            if depth:
                up = self.levels[depth - 1]
                kids = up["kids"][node]
                node = np.repeat(up["first"][node] - np.r_[0, np.cumsum(kids)[:-1]], kids) + np.arange(kids.sum())
                q, acc = np.repeat(q, kids), np.repeat(acc, kids)
            acc = acc + np.bitwise_count((fp[q] ^ level["pattern"][node]) & level["rest"][node])
            self.visited[depth] += len(q)
            self.pruned[depth] += int((acc > radius).sum())
            near = acc <= radius
            q, node, acc = q[near], node[near], acc[near]
            # all of the group is near and in one component: its first member stands for it
            whole = (acc + level["free"][node] <= radius) & (one[depth][node] >= 0)
            out.append(np.stack([q[whole], level["start"][node[whole]]]))
            q, node, acc = q[~whole], node[~whole], acc[~whole]
            if depth < len(self.levels) - 1:
                stack += [(depth + 1, q[i : i + step], node[i : i + step], acc[i : i + step]) for i in range(0, len(q), step)]
        found = np.concatenate(out, axis=1) if out else np.zeros((2, 0), np.int64)
        found = np.stack([found[0], root[found[1]]]) if found.size else found
        found = np.unique(found, axis=1)
        return found[0], found[1]

    @staticmethod
    def _take(q: np.ndarray, node: np.ndarray, level: dict, parent: np.ndarray) -> None:
        """Link queries to every member of their nodes, some members at a time."""
        size = level["end"][node] - level["start"][node]
        for i in range(int(size.max())):
            some = size > i
            _unite(parent, q[some], level["start"][node[some]] + i)


def _uniform(root: np.ndarray, start: np.ndarray) -> np.ndarray:
    """For each node the component that all its members are in, or -1."""
    low, high = np.minimum.reduceat(root, start), np.maximum.reduceat(root, start)
    return np.where(low == high, low, -1)


def _roots(parent: np.ndarray) -> np.ndarray:
    while True:
        up = parent[parent]
        if np.array_equal(up, parent):
            return parent
        parent[:] = up


def _unite(parent: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Join the components of each pair; a component is named by its first position."""
    while len(a):
        root = _roots(parent)
        a, b = root[a], root[b]
        apart = a != b
        a, b = a[apart], b[apart]
        np.minimum.at(parent, np.maximum(a, b), np.minimum(a, b))


def gray_rank_column(fp: Column) -> Column:
    """``gray_rank`` of a signed long; the order of signed ranks keeps shared prefixes together as well."""
    for n in (1, 2, 4, 8, 16, 32):
        fp = fp.bitwiseXOR(F.shiftrightunsigned(fp, n))
    return fp


def routing_bits(n: int) -> int:
    """Bits of a block that make a key of n fingerprints keep KEEP members or more."""
    return max(0, min(16, (n // KEEP).bit_length() - 1))


def routed(fps: DataFrame, bits: int) -> DataFrame:
    """(key, fp): a row for each of the four tables, or one for all if no bits route."""
    if not bits:
        return fps.select(F.lit(0).cast("long").alias("key"), "fp")
    block = lambda t: F.shiftrightunsigned(F.col("fp"), 16 * t).bitwiseAND(F.lit((1 << bits) - 1).cast("long"))
    return fps.select("fp", F.explode(F.array(*[block(t).bitwiseOR(F.lit(t << 16).cast("long")) for t in range(4)])).alias("key")).select("key", "fp")


def _links_of(index: GrayIndex, fp: np.ndarray) -> pd.DataFrame:
    a, b = index.links()
    x, y = fp[a].view(np.int64), fp[b].view(np.int64)
    return pd.DataFrame({"a": np.maximum(x, y), "b": np.minimum(x, y)})


def segments(fps: DataFrame, bits: int, per_task: int, most: int) -> DataFrame:
    """Rows of two kinds, staged: a member of a segment (seg, key, fp), and a spanning link inside a segment (a, b).

    A segment is a key, or a run of it in Gray order where the key has more than ``most`` members. Trees of small keys are
    built and searched together.
    """
    keyed = routed(fps, bits).withColumn("rank", gray_rank_column(F.col("fp")))
    sizes = staged(keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > most), "hot-keys")
    largest = sizes.agg(F.max("n")).first()[0]
    if largest:
        pieces = -(-largest // most) + 1
        cuts = F.percentile_approx("rank", [i / pieces for i in range(1, pieces)])
        bounds = staged(keyed.join(sizes.select("key"), "key", "left_semi").groupBy("key").agg(cuts.alias("cuts")), "hot-cuts")
        keyed = keyed.join(bounds, "key", "left").withColumn("sub", F.coalesce(F.size(F.filter("cuts", lambda c: c < F.col("rank"))), F.lit(0)))
    else:
        keyed = keyed.withColumn("sub", F.lit(0))
    parts = max(parallelism(fps.sparkSession), fps.count() * (4 if bits else 1) // per_task + 1)
    ordered = keyed.repartition(parts, "key", "sub").sortWithinPartitions("key", "sub", "rank").select(F.spark_partition_id().alias("part"), "key", "sub", "fp")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seg, held, size = 0, [], 0

        def flush(key: np.ndarray, sub: np.ndarray, fp: np.ndarray, part: int) -> Iterator[pd.DataFrame]:
            nonlocal seg
            first = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]) | (sub[1:] != sub[:-1])])
            place = np.arange(len(key)) - np.repeat(first, np.diff(np.r_[first, len(key)]))
            own = np.cumsum((place % most == 0).astype(np.int64)) - 1
            n = int(own[-1]) + 1
            nothing = pd.array([None] * len(fp), "Int64")
            yield pd.DataFrame({"seg": (np.int64(part) << 32) + seg + own, "key": key, "fp": fp.view(np.int64), "a": nothing, "b": nothing})
            seg += n
            links = _links_of(GrayIndex(own, fp), fp)
            if len(links):
                nothing = pd.array([None] * len(links), "Int64")
                yield pd.DataFrame({"seg": nothing, "key": nothing, "fp": nothing, "a": links["a"].astype("Int64"), "b": links["b"].astype("Int64")})

        part = 0
        for b in batches:
            part = int(b["part"].iloc[0])
            held.append((b["key"].to_numpy(np.int64), b["sub"].to_numpy(np.int64), b["fp"].to_numpy(np.int64).view(np.uint64)))
            size += len(b)
            if size >= most:  # whole segments so far; the last one may go on
                key, sub, fp = (np.concatenate(x) for x in zip(*held))
                cut = int(np.flatnonzero((key != key[-1]) | (sub != sub[-1]))[-1]) + 1 if (key[0], sub[0]) != (key[-1], sub[-1]) else 0
                if cut:
                    yield from flush(key[:cut], sub[:cut], fp[:cut], part)
                held, size = [(key[cut:], sub[cut:], fp[cut:])], size - cut
        if size:
            yield from flush(*(np.concatenate(x) for x in zip(*held)), part)

    return staged(ordered.mapInPandas(run, "seg long, key long, fp long, a long, b long"), "segments")


def hamming_links(fps: DataFrame, per_task: int = 1 << 17, most: int = SEGMENT, bits: int | None = None) -> DataFrame:
    """Spanning links (a, b) of the graph on distinct fingerprints ``fps.fp`` within RADIUS bits, b the smaller."""
    bits = routing_bits(fps.count()) if bits is None else bits
    rows = segments(fps, bits, per_task, most)
    members = rows.filter("seg is not null").select("seg", "key", "fp")
    inside = rows.filter("a is not null").select("a", "b")

    # the roots of the keys that have several segments: one row for about every ``most`` rows of a hot key
    nodes = members.groupBy("key", "seg").agg(F.bit_and("fp").alias("ones"), F.bit_or("fp").alias("some"), F.count(F.lit(1)).alias("n"))
    several = nodes.groupBy("key").agg(F.count(F.lit(1)).alias("segs")).filter("segs > 1").select("key")
    roots = staged(nodes.join(several, "key").select("key", F.col("seg").alias("other"), "ones", F.bitwise_not(F.col("ones").bitwiseXOR(F.col("some"))).alias("mask")), "segment-roots")
    far = F.bit_count(F.col("fp").bitwiseXOR(F.col("ones")).bitwiseAND(F.col("mask")))
    asked = members.join(roots, "key").filter((F.col("seg") < F.col("other")) & (far <= RADIUS)).select(F.col("other").alias("seg"), "fp")
    asked = staged(asked, "segment-queries")
    # a segment's queries in lots of about ``most``, each met by a copy of the members, so that a group is bounded
    lots = asked.groupBy("seg").agg(F.floor(F.count(F.lit(1)) / most + 1).cast("int").alias("lots"))
    queries = asked.join(lots, "seg").select("seg", F.pmod(F.xxhash64("fp"), F.col("lots")).cast("int").alias("lot"), "fp")
    met = members.join(lots, "seg").select("seg", F.explode(F.sequence(F.lit(0), F.col("lots") - 1)).alias("lot"), "fp")

    def across(q: pd.DataFrame, m: pd.DataFrame) -> pd.DataFrame:
        fp, own = q["fp"].to_numpy(np.int64).view(np.uint64), m["fp"].to_numpy(np.int64).view(np.uint64)
        if not len(fp) or not len(own):
            return pd.DataFrame({"a": np.zeros(0, np.int64), "b": np.zeros(0, np.int64)})
        own = own[np.argsort(gray_rank(own))]
        index = GrayIndex(np.zeros(len(own), np.int64), own)
        index.links()
        at, to = index.matches(fp)
        x, y = fp[at].view(np.int64), own[to].view(np.int64)
        return pd.DataFrame({"a": np.maximum(x, y), "b": np.minimum(x, y)})

    between = queries.groupBy("seg", "lot").cogroup(met.groupBy("seg", "lot")).applyInPandas(across, "a long, b long")
    return inside.unionByName(between).distinct()


def components(links: DataFrame) -> DataFrame:
    """(v, root) of every vertex of ``links`` (a, b longs); root is the component's smallest vertex.

    Alternates large-star and small-star until nothing changes; a round moves each link once. The
    joins are plain ones of staged tables, so adaptive execution splits the partitions of a hub.
    """
    links = staged(links.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    said = None
    while True:
        now = links.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == said:
            return links.select(F.col("a").alias("v"), F.col("b").alias("root")).unionByName(links.select(F.col("b").alias("v"), F.col("b").alias("root")).distinct())
        said = now
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = staged(both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m")), "large-min")
        large = staged(both.filter("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct(), "large-star")
        down = staged(large.groupBy("a").agg(F.min("b").alias("m")), "small-min")
        small = large.join(down, "a").select(F.explode(F.array(F.struct("b", "m"), F.struct(F.col("a").alias("b"), "m"))).alias("x")).select(F.col("x.b").alias("a"), F.col("x.m").alias("b"))
        after = staged(small.filter("a <> b").distinct(), "links")
        for old in (links, low, large, down):
            drop_staged(old)
        links = after


def simhash_groups(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, carry: tuple[str, ...] = ()) -> DataFrame:
    """id, fp, component_id, component and the ``carry`` columns of every row.

    component_id is the smallest id reachable over links of at most 3 bits; ``component`` is the smallest fingerprint of
    these (as a signed long) and so tells components apart even where rows share an id or have none.
    """
    names = [f"_c{i}" for i in range(len(carry))]
    given = df.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"), *[F.col(c).alias(n) for c, n in zip(carry, names)])
    rows = staged(fingerprints(given, "_id", "_text", shingle, tuple(names)), "fingerprints")
    fps = staged(rows.groupBy("fp").agg(F.min("_id").alias("_low")), "distinct-fps")
    roots = staged(components(hamming_links(fps.select("fp"))).withColumnRenamed("v", "fp"), "roots")
    owned = fps.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    named = owned.join(owned.groupBy("root").agg(F.min("_low").alias("component_id")), "root")
    table = staged(named.select("fp", "component_id", F.col("root").alias("component")), "components")
    return rows.join(table, "fp").select(F.col("_id").alias(id_col), "fp", "component_id", "component", *[F.col(n).alias(c) for c, n in zip(carry, names)])
