"""Column functions on line fields: days, timestamps, truncation, workload owners, labels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NANO = 10**9


def as_timestamp(ts_ns: Column) -> Column:
    """To microseconds, for display and windows."""
    return F.timestamp_micros(_div(ts_ns, 1000))


def day(ts_ns: Column) -> Column:
    """UTC day as YYYYMMDD, in a session whose zone is UTC."""
    return F.date_format(F.timestamp_seconds(_div(ts_ns, NANO)), "yyyyMMdd")


def rfc3339(ts_ns: Column) -> Column:
    """RFC 3339 in UTC with nanoseconds, zeros at the end of the fraction left out."""
    fraction = F.rtrim(F.lpad(F.pmod(ts_ns, F.lit(NANO)).cast("string"), 9, "0"), F.lit("0"))
    return F.concat(
        F.date_format(F.timestamp_seconds(_div(ts_ns, NANO)), "yyyy-MM-dd'T'HH:mm:ss"),
        F.when(fraction == "", "").otherwise(F.concat(F.lit("."), fraction)),
        F.lit("Z"),
    )


def _div(x: Column, by: int) -> Column:
    """Floor division of longs, exact: no detour by doubles."""
    return F.call_function("div", x - F.pmod(x, F.lit(by)), F.lit(by))


def truncated(msg: Column, limit: int = 256 << 10, mark: str = "…[truncated]") -> Column:
    """At most ``limit`` bytes of the line, with a mark where it was cut."""
    cut = F.make_valid_utf8(F.substring(F.encode(msg, "UTF-8"), 1, limit).cast("string"))
    return F.when(F.octet_length(msg) > limit, F.concat(cut, F.lit(mark))).otherwise(msg)


def stored_bytes(msg: Column) -> Column:
    """What a line counts for: its bytes and 13 of frame."""
    return F.octet_length(msg).cast("long") + 13


# How generated names end.
REPLICA_HASH = r"-[bcdfghjklmnpqrstvwxz0-9]{5,10}$"
SCHEDULED = r"-[0-9]{8,}$"


def owner(pod: Column, kind: Column, name: Column) -> Column:
    """The workload of a pod from its first owner reference (null kind: none)."""
    slash = lambda k, v: F.concat(F.lit(f"{k}/"), v)
    suffix = F.concat(F.lit("-"), name)
    return (
        F.when(kind.isNull(), slash("Pod", pod))
        .when(kind == "ReplicaSet", slash("Deployment", F.regexp_replace(name, REPLICA_HASH, "")))
        .when((kind == "Job") & name.rlike(SCHEDULED), slash("CronJob", F.regexp_replace(name, SCHEDULED, "")))
        .when(kind == "Node", slash("Pod", F.when(pod.endswith(suffix), F.left(pod, F.length(pod) - F.length(suffix))).otherwise(pod)))
        .otherwise(F.concat(kind, F.lit("/"), name))
    )


def selected_labels(labels: Column, annotations: Column, label_keys: list[str], annotation_keys: list[str], owned_by: Column) -> Column:
    """Chosen labels and annotations (these win) and the owner under ``_owner``."""
    empty = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))
    some = lambda m, keys: F.map_filter(F.coalesce(m, empty), lambda k, _: k.isin(keys)) if keys else empty
    noted = some(annotations, annotation_keys)
    kept = F.map_filter(some(labels, label_keys), lambda k, _: ~F.map_contains_key(noted, k))
    base = F.map_filter(F.map_concat(kept, noted), lambda k, _: k != "_owner")
    return F.map_concat(F.create_map(F.lit("_owner"), owned_by), base)


def workload_guess(pod: Column) -> Column:
    """A workload's name from a pod's name alone: generated endings fall off."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(pod, r"-[bcdfghjklmnpqrstvwxz0-9]{5}$", ""), REPLICA_HASH, ""), r"-[0-9]+$", "")


def stream_key(key: Column) -> Column:
    """struct(ns, pod, uid, ctr) of ``ns/pod/uid/ctr``; null unless there are exactly four parts."""
    p = F.split(key, "/", 4)
    names = ("ns", "pod", "uid", "ctr")
    return F.when(F.size(p) == 4, F.struct(*[F.get(p, F.lit(i)).alias(n) for i, n in enumerate(names)]))


def stream_id(*identity: Column) -> Column:
    """A stream's id: a hash of cluster, ns, pod, uid and ctr."""
    return F.xxhash64(*identity)


def file_fingerprint(first_line: Column) -> Column:
    return F.xxhash64(first_line)


def heartbeat_stats(stats: Column) -> Column:
    """Map of ``k=v;k=v``; a key's last value counts, pieces without ``=`` drop out."""
    pairs = F.transform(F.filter(F.split(stats, ";"), lambda x: F.contains(x, F.lit("="))), lambda x: F.struct(F.substring_index(x, "=", 1).alias("k"), F.substring(x, F.instr(x, "=") + 1, F.length(x)).alias("v")))
    keys = F.transform(pairs, lambda p: p["k"])
    last = F.filter(pairs, lambda p, i: ~F.array_contains(F.slice(keys, i + 2, F.greatest(F.size(keys) - i - 1, F.lit(0))), p["k"]))
    return F.map_from_entries(last)
