"""A streaming source that follows files as they grow, which the file source cannot.

Offsets map each file (path and fingerprint of its first line) to the bytes read. A file that shrank or whose
first line changed is a new file under its old name. A line without its line break stays until it has one. A file
that was rotated away (its path and one more ending, uncompressed) is still the file that it was: its rest is read
under the old path, and so is all of one that was rotated before the stream began. Compressed files are left to
the directory scan. Paths are local to the machine that runs both the driver and the tasks.
"""

from __future__ import annotations

import glob
import os
from zlib import crc32

from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition


def _key(at: str, path: str) -> str | None:
    """Path and first line's fingerprint of the file that lies at ``at``; None while it has no whole line."""
    try:
        with open(at, "rb") as f:
            first = f.readline(64 << 10)
    except OSError:
        return None
    return f"{path}\t{crc32(first):08x}" if first.endswith(b"\n") or len(first) == 64 << 10 else None


def _rotated(pattern: str) -> list[str]:
    return sorted(p for p in glob.glob(f"{pattern}.*", recursive=True) if not p.endswith(".gz"))


def _located(key: str) -> str | None:
    """Where the file of a key lies now; None if it is gone."""
    path = key.split("\t")[0]
    return next((at for at in [path, *_rotated(glob.escape(path))] if _key(at, path) == key), None)


def _cuts(key: str, start: int, end: int, most: int) -> list[tuple[int, int]]:
    """Ranges of whole lines, each of about ``most`` bytes."""
    at = _located(key)
    if at is None:
        return []
    out = []
    with open(at, "rb") as f:
        while start < end:
            f.seek(min(start + most, end) - 1)
            f.readline()
            stop = min(f.tell(), end)
            out.append((start, stop))
            start = stop
    return out


class _Piece(InputPartition):
    def __init__(self, key: str, start: int, end: int):
        self.key, self.start, self.end = key, start, end


class _Reader(DataSourceStreamReader):
    def __init__(self, options: dict):
        self.pattern = options["path"]
        self.most = int(options.get("maxbytes", 64 << 20))

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        own = sorted(glob.glob(self.pattern, recursive=True))
        gone = [p for p in _rotated(self.pattern) if p not in set(own)]  # those that the pattern names are files of their own
        out = {}
        for at, path in [*((p, p) for p in own), *((p, p.rpartition(".")[0]) for p in gone)]:
            key = _key(at, path)
            if key and key not in out:
                out[key] = _whole_lines(at)
        return out

    def partitions(self, start: dict, end: dict) -> list[_Piece]:
        return [_Piece(k, a, b) for k, n in end.items() for a, b in _cuts(k, start.get(k, 0), n, self.most)]

    def read(self, partition: _Piece):
        at, path = _located(partition.key), partition.key.split("\t")[0]
        if at is None:
            return
        with open(at, "rb") as f:
            f.seek(partition.start)
            at = partition.start
            while at < partition.end:
                line = f.readline(partition.end - at)
                if not line:
                    break
                yield path, at, at + len(line), line.rstrip(b"\n").decode("utf-8", "replace")
                at += len(line)

    def commit(self, end: dict) -> None:
        """Spark's checkpoint holds the offsets."""


def _whole_lines(path: str, step: int = 1 << 16) -> int:
    """End of the last whole line."""
    with open(path, "rb") as f:
        end = f.seek(0, os.SEEK_END)
        while end:
            start = max(0, end - step)
            f.seek(start)
            cut = f.read(end - start).rfind(b"\n")
            if cut >= 0:
                return start + cut + 1
            end = start
    return 0


class FollowSource(DataSource):
    """``spark.readStream.format("follow").option("path", glob)``: path, off_start, off_end, value.

    Option ``maxbytes`` (64 MB): about how much a partition reads.
    """

    @classmethod
    def name(cls) -> str:
        return "follow"

    def schema(self) -> str:
        return "path string, off_start bigint, off_end bigint, value string"

    def streamReader(self, schema) -> _Reader:
        return _Reader({k.lower(): v for k, v in self.options.items()})
