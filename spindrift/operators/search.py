"""Searches over lines: selector, range, filter, newest first; paging, export, federation."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spindrift.functions import globs
from spindrift.functions.filters import matches
from spindrift.functions.lines import as_timestamp, rfc3339
from spindrift.operators.skipping import without_ruled_out

STORE_UNIT = ("day", "cluster", "ns", "batch")  # the store's directories
MAX_LIMIT, DEFAULT_LIMIT, EXPORT_LIMIT = 5000, 500, 1_000_000


@dataclass
class Role:
    """What an identity may see; empty lists allow everything."""

    clusters: list[str] = field(default_factory=list)
    namespaces: list[str] = field(default_factory=list)

    def column(self) -> Column:
        return globs.allows_any(F.col("cluster"), self.clusters) & globs.allows_any(F.col("ns"), self.namespaces)


@dataclass
class Selector:
    cluster: str = ""
    ns: str = ""
    pod: str = ""
    ctr: str = ""
    uid: str = ""
    sids: list[str] | None = None
    since: int = 0
    labels: list[str] = field(default_factory=list)
    role: Role | None = None

    def label_pairs(self) -> dict[str, str]:
        """``k:v`` or ``k=v``, split at the first of either after the start; a later pair of a key wins."""
        out = {}
        for text in self.labels:
            cut = min((i for i in (text.find(":", 1), text.find("=", 1)) if i > 0), default=0)
            if cut:
                out[text[:cut].replace('"', "")] = text[cut + 1 :]
        return out

    def column(self, columns: list[str]) -> Column:
        """The predicate; parts on columns that the table lacks must not be set."""
        out = F.lit(True)
        for name in ("cluster", "ns", "pod", "ctr"):
            if (pattern := getattr(self, name)) not in ("", "*"):
                out &= globs.selects(F.col(name), pattern)
        if self.uid:
            out &= F.col("uid") == self.uid
        if self.sids is not None:
            ids = [int(s) for s in self.sids if s.lstrip("-").isdigit()]
            out &= F.col("sid").isin(ids) if ids else F.lit(not self.sids)
        if self.since > 0:
            out &= F.col("last_ts") >= self.since
        for k, v in self.label_pairs().items():
            out &= F.coalesce(F.element_at("labels", k) == v, F.lit(False))
        return out & self.role.column() if self.role else out


def clamp(limit) -> int:
    """A query's limit: anything out of 1..5000 is the default."""
    try:
        n = int(limit)
    except (TypeError, ValueError):
        return DEFAULT_LIMIT
    return n if 0 < n <= MAX_LIMIT else DEFAULT_LIMIT


def in_range(df: DataFrame, start: int, end: int) -> DataFrame:
    """Both ends count. Where the table has days, they are pruned as well."""
    out = df.filter(F.col("ts_ns").between(start, end))
    if "day" in df.columns:
        days = [F.date_format(as_timestamp(F.lit(x)), "yyyyMMdd") for x in (start, end)]
        out = out.filter(F.col("day").between(*days))
    return out


def search(lines: DataFrame, selector: Selector, start: int, end: int, query: str = "", exact: bool = False, skip: DataFrame | None = None, unit: Sequence[str] = STORE_UNIT) -> DataFrame:
    """Lines that pass, in no order. With ``skip``, a trigram table by ``unit``, units that it rules out are not read."""
    read = in_range(lines.filter(selector.column(lines.columns)), start, end)
    if skip is not None:
        read = without_ruled_out(read, skip, query, unit)
    return read.filter(matches("msg", query, exact))


def newest(lines: DataFrame, limit: int = DEFAULT_LIMIT) -> DataFrame:
    """The newest lines, newest first; ties by the order of ingest."""
    return lines.orderBy(F.desc("ts_ns"), F.desc("seq")).limit(limit)


def before(lines: DataFrame, ts_ns: int, seq: int | None = None) -> DataFrame:
    """The next page: older than a time, or than a (time, seq) cursor, which loses no line of an equal time."""
    older = F.col("ts_ns") < ts_ns
    return lines.filter(older if seq is None else older | (F.col("ts_ns") == ts_ns) & (F.col("seq") < seq))


@dataclass
class Page:
    rows: list
    truncated: bool
    next_end: int | None
    cursor: tuple[int, int] | None


def page(lines: DataFrame, limit: int = DEFAULT_LIMIT) -> Page:
    """One page on the driver, at most limit+1 rows: the one too many tells whether there are more."""
    got = newest(lines, limit + 1).collect()
    more, rows = len(got) > limit, got[:limit]
    last = rows[-1] if rows and more else None
    return Page(rows, more, last.ts_ns - 1 if last else None, (last.ts_ns, last.seq) if last else None)


def page_within(lines: DataFrame, days: DataFrame, limit: int = DEFAULT_LIMIT) -> Page:
    """A page from the days that a scan budget allows (``catalog.days_in_budget``, a row a day).

    It is truncated, too, if it is not full and days were left out.
    """
    plan = days.collect()
    got = page(lines.filter(F.col("day").isin([r.day for r in plan if r.scanned])), limit)
    return replace(got, truncated=got.truncated or len(got.rows) < limit and not all(r.scanned for r in plan))


def newest_by_day(lines: DataFrame, days: list[str] | None, limit: int) -> DataFrame:
    """``newest`` that reads whole days from the latest back until it has enough; days part the time line, so it is the same.

    With ``days``, those of a table parted by day, one day after another is counted; without, one pass counts all.
    """
    if days is None:
        counts = {r.day: r.n for r in lines.groupBy("day").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row a day
        chosen, have = [], 0
        for d in sorted(counts, reverse=True):
            chosen.append(d)
            have += counts[d]
            if have >= limit:
                break
        return newest(lines.filter(F.col("day").isin(chosen)), limit)
    chosen: list[str] = []
    have = 0
    for d in sorted(days, reverse=True):
        chosen.append(d)
        have += lines.filter(F.col("day") == d).limit(limit).count()
        if have >= limit:
            break
    return newest(lines.filter(F.col("day").isin(chosen)), limit)


def api_line(df: DataFrame) -> DataFrame:
    """JSON of a result line; false and zero are left out."""
    return df.select(
        F.to_json(F.struct(F.col("sid").cast("string").alias("sid"), F.col("ts_ns").alias("t"), F.when(F.col("stderr"), F.lit(True)).alias("e"), F.col("msg").alias("m"), F.when(F.col("restart") > 0, F.col("restart")).alias("r"))).alias("line")
    )


def stream_name() -> Column:
    return F.concat_ws("/", "cluster", "ns", "pod", "ctr")


def named(lines: DataFrame, streams: DataFrame) -> DataFrame:
    """Lines with their stream's display name; '' where the stream is unknown."""
    names = streams.select("sid", stream_name().alias("stream"))
    return lines.join(names, "sid", "left").withColumn("stream", F.coalesce("stream", F.lit("")))


def export_text(df: DataFrame, name: Column, limit: int = EXPORT_LIMIT) -> DataFrame:
    """``<time> <stream> <message>``, oldest first."""
    line = F.concat_ws(" ", rfc3339(F.col("ts_ns")), name, F.col("msg"))
    return newest(df, limit).orderBy("ts_ns", "seq").select(line.alias("line"))


def export_ndjson(df: DataFrame, name: Column, limit: int = EXPORT_LIMIT) -> DataFrame:
    line = F.to_json(F.struct(F.col("ts_ns").alias("t"), name.alias("stream"), F.col("stderr"), F.col("restart"), F.col("msg").alias("m")))
    return newest(df, limit).orderBy("ts_ns", "seq").select(line.alias("line"))


def exporter(df: DataFrame, name: Column, kind: str = "txt") -> Iterator[str]:
    """Lines one by one, a partition at a time on the driver."""
    out = export_ndjson(df, name) if kind == "ndjson" else export_text(df, name)
    return (r.line for r in out.toLocalIterator())


def federated(parts: dict[str, DataFrame], separator: str = "/") -> DataFrame:
    """Union of the peers' tables; ids get their peer's name in front, the local one's ('') stay."""
    out = None
    for peer, df in parts.items():
        sid = F.concat(F.lit(f"{peer}{separator}" if peer else ""), F.col("sid").cast("string"))
        df = df.withColumn("sid", sid)
        out = df if out is None else out.unionByName(df, allowMissingColumns=True)
    return out


def routed(sids: DataFrame, separator: str = "/") -> DataFrame:
    """sid -> peer ('' is local) and the id there."""
    at = F.instr("sid", separator)
    return sids.select("sid", F.when(at > 0, F.left("sid", at - 1)).otherwise("").alias("peer"), F.substring("sid", at + 1, F.length("sid")).alias("local"))


def merged_status(parts: DataFrame) -> DataFrame:
    """Sums and ORs over the peers' answers."""
    return parts.agg(F.sum("scanned").alias("scanned"), F.sum("skipped").alias("skipped"), F.sum("chunks").alias("chunks"), F.bool_or("truncated").alias("truncated"), F.array_sort(F.flatten(F.collect_list("errors"))).alias("errors"))
