"""WARC archives: a writer with digest-based revisit records and a salvaging reader.

Writing: one gzip member a record, files rolled at a byte limit, each under a name of its own; a
manifest row a file comes back from the task. A task that is run again writes new files, and only
the files of the attempt whose manifest rows Spark kept are read, so lost executors leave no
duplicates. Payloads that no other row has are written where they are read; of repeated payloads only the response's
is shuffled. Reading: every record is checked (gzip CRC, version line, Content-Length, block digest).
After a failed check the reader searches for the next gzip member or version line, whichever comes first and parses,
whatever the archive began with, goes on from there and logs the bytes between as a quarantined gap. A member may hold
several records: the first carries the member's length, the others length 0 and their place inside it. Archives are
read piece by piece; a record is the most that is held.

Defined cases: a null payload is empty, a null url is written as an empty target, null ids are kept
(as ``null``), rows that repeat an id with the same payload are all written as responses or all as
revisits, an empty table writes no file and reads back as no rows; other columns are ignored. Folded header lines
and any version number are read; a payload length that is no number counts as 0.
"""

from __future__ import annotations

import base64
import hashlib
import io
import re
import uuid
import zlib
from collections.abc import Iterator
from typing import BinaryIO

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spindrift.llm.common import filesystem, fresh_dir, parallelism, staged
from spindrift.llm.exact_dedup import _bit_table, _probe, bits_for

DATE = "1970-01-01T00:00:00Z"
MANIFEST = "file string, records long, bytes long"
RECORDS = (
    "file string, offset long, length long, inside long, kind string, record_type string, record_id string, target string, "
    "refers_to string, payload_bytes long, payload_digest string, payload binary, reason string"
)


def digest32(data: bytes) -> str:
    """Bare upper-case base32 of SHA-1."""
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def make_record(page_id: str, url: str, payload: bytes, refers_to: str | None, told: tuple[int, str] | None = None) -> bytes:
    """One uncompressed WARC/1.1 record; a revisit has the HTTP head alone as its block, and may be told its payload's length and digest."""
    size, digest = told or (len(payload), digest32(payload))
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % size
    head = [
        "WARC/1.1",
        "WARC-Type: " + ("response" if refers_to is None else "revisit"),
        f"WARC-Record-ID: <urn:page:{page_id}>",
        f"WARC-Date: {DATE}",
        "WARC-Target-URI: " + "".join(f"%{ord(c):02X}" if c in "\r\n\0" else c for c in url),
        f"WARC-Payload-Digest: sha1:{digest}",
        f"X-Payload-Length: {size}",
    ]
    if refers_to is None:
        block += payload
    else:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    head += [f"WARC-Block-Digest: sha1:{digest32(block)}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + block + b"\r\n\r\n"


def gzip_member(data: bytes, level: int = 4) -> bytes:
    z = zlib.compressobj(level, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


def _ident(x) -> str:
    return "null" if x is None else x


def write_warc(
    df: DataFrame,
    out_dir: str | None = None,
    id_col: str = "page_id",
    url_col: str = "url",
    payload_col: str = "html",
    min_revisit_bytes: int = 0,
    roll_bytes: int = 16 << 20,
) -> DataFrame:
    """Write a record for each row; returns the manifest (file, records, bytes) as a staged table.

    Of rows with equal payloads of at least ``min_revisit_bytes`` bytes the one with the smallest id is the
    response and the others revisit it.
    """
    spark = df.sparkSession
    out_dir = (out_dir or fresh_dir(spark, "warc")).rstrip("/")
    rows = df.select(
        F.col(id_col).cast("long").alias("_id"),
        F.coalesce(F.col(url_col), F.lit("")).alias("_url"),
        F.coalesce(F.col(payload_col), F.lit("")).alias("_payload"),
    ).withColumn("_sha", F.sha1("_payload"))
    eligible = rows.filter(F.octet_length("_payload") >= min_revisit_bytes)
    groups = staged(eligible.groupBy("_sha").agg(F.min("_id").alias("_first"), F.count(F.lit(1)).alias("_n")).filter("_n > 1").drop("_n"), "warc-groups")
    bits = bits_for(groups.count())
    repeated = staged(_bit_table(groups, F.xxhash64("_sha"), bits), "warc-bits")
    probed = _probe(rows, repeated, F.xxhash64("_sha"), bits, "_hit")
    nothing = F.lit(None).cast("string")
    name = lambda c: F.col(c).cast("string").alias(c)
    single = probed.filter("not _hit").select(name("_id"), "_url", "_payload", nothing.alias("_first"), nothing.alias("_bytes"), nothing.alias("_told"))
    # rows of repeated payloads go without them, told by length and digest; only the responses' payloads are fetched
    narrow = probed.filter("_hit").select("_id", "_url", "_sha", F.octet_length("_payload").alias("_bytes"))
    placed = staged(narrow.join(groups, "_sha", "left"), "warc-repeated")
    revisit = F.col("_first").isNotNull() & ~F.col("_id").eqNullSafe(F.col("_first"))
    revisits = placed.filter(revisit).select(name("_id"), "_url", F.lit("").alias("_payload"), name("_first"), name("_bytes"), F.col("_sha").alias("_told"))
    kept = placed.filter(~revisit).select(F.col("_id").alias("_kid"), F.col("_sha").alias("_ksha")).distinct()
    kept_bits = staged(_bit_table(kept, F.xxhash64("_kid", "_ksha"), bits), "warc-response-bits")
    held = _probe(probed.filter("_hit").drop("_hit"), kept_bits, F.xxhash64("_id", "_sha"), bits, "_hit").filter("_hit")
    firsts = held.join(kept, F.col("_id").eqNullSafe(F.col("_kid")) & (F.col("_sha") == F.col("_ksha")), "left_semi")
    records = single.unionByName(firsts.select(name("_id"), "_url", "_payload", nothing.alias("_first"), nothing.alias("_bytes"), nothing.alias("_told"))).unionByName(revisits)

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fs, root = filesystem(out_dir)
        fs.create_dir(root, recursive=True)
        sink, name, n, size = None, "", 0, 0
        for pdf in batches:
            for i, url, payload, first, size_, told in zip(pdf["_id"], pdf["_url"], pdf["_payload"], pdf["_first"], pdf["_bytes"], pdf["_told"]):
                if sink is None:
                    name, n, size = f"{uuid.uuid4().hex}.warc.gz", 0, 0
                    sink = fs.open_output_stream(f"{root}/{name}", compression=None)
                as_told = None if told is None else (int(size_), base64.b32encode(bytes.fromhex(told)).decode())
                member = gzip_member(make_record(_ident(i), url, payload.encode("utf-8", "surrogatepass"), first, as_told))
                sink.write(member)
                n, size = n + 1, size + len(member)
                if size >= roll_bytes:
                    sink.close()
                    sink = None
                    yield pd.DataFrame({"file": [f"{out_dir}/{name}"], "records": [n], "bytes": [size]})
        if sink is not None:
            sink.close()
            yield pd.DataFrame({"file": [f"{out_dir}/{name}"], "records": [n], "bytes": [size]})

    return staged(records.mapInPandas(write, MANIFEST), "warc-manifest")


MARK = re.compile(rb"\x1f\x8b\x08|WARC/[0-9]")
VERSION = re.compile(rb"WARC/[0-9]+\.[0-9]+\r\n")
HEAD_BYTES = 1 << 20  # a record's header lines must end within so many bytes


class Short(ValueError):
    """The data end before the record does."""


def _digest_fits(said: str, block: bytes) -> bool:
    """Only SHA-1 is checked, in base32 or hexadecimal."""
    kind, _, value = said.partition(":")
    return kind.lower() != "sha1" or value.upper() == digest32(block) or value.lower() == hashlib.sha1(block).hexdigest()


def parse_record(data: bytes, at: int = 0) -> dict:
    """Check and take apart the record that begins at ``at``; ValueError names the failed check."""
    if not VERSION.match(data, at):
        raise Short("no version line") if len(data) - at < 16 and data[at : at + 5] == b"WARC/"[: len(data) - at] else ValueError("no version line")
    end = data.find(b"\r\n\r\n", at, at + HEAD_BYTES)
    if end < 0:
        raise Short("header is cut off") if len(data) - at < HEAD_BYTES else ValueError("header does not end")
    lines: list[str] = []
    for line in data[at:end].decode("utf-8", "replace").split("\r\n")[1:]:
        if line[:1] in (" ", "\t") and lines:
            lines[-1] += " " + line.strip()
        else:
            lines.append(line)
    fields = {}
    for line in lines:
        k, colon, v = line.partition(":")
        if not colon:
            raise ValueError("malformed header line")
        fields[k.strip().lower()] = v.strip()
    try:
        length = int(fields["content-length"])
        kind, ident = fields["warc-type"], fields["warc-record-id"]
    except (KeyError, ValueError):
        raise ValueError("mandatory header missing") from None
    stop = end + 4 + length
    if length < 0 or stop + 4 > len(data):
        raise ValueError("content length does not fit") if length < 0 else Short("content length does not fit")
    if data[stop : stop + 4] != b"\r\n\r\n":
        raise ValueError("content length does not fit")
    block = data[end + 4 : stop]
    if not _digest_fits(fields.get("warc-block-digest", ""), block):
        raise ValueError("block digest differs")
    strip = lambda x: x[len("<urn:page:") : -1] if x and x.startswith("<urn:page:") else x
    payload = block.partition(b"\r\n\r\n")[2] if kind == "response" else b""
    told = fields.get("x-payload-length", "")
    return {
        "record_type": kind,
        "record_id": strip(ident),
        "target": fields.get("warc-target-uri", ""),
        "refers_to": strip(fields.get("warc-refers-to")),
        "payload_bytes": len(payload) if kind == "response" else int(told) if told.isdecimal() else 0,
        "payload_digest": digest32(payload) if kind == "response" else fields.get("warc-payload-digest", "").removeprefix("sha1:"),
        "payload": payload,
        "size": stop + 4 - at,
    }


Found = tuple[str, int, int, int | None, dict | str]


def _member(data: bytes, at: int, step: int = 1 << 16) -> tuple[bytes, int]:
    """(inflated bytes, length) of the gzip member that begins at ``at``."""
    z, plain, end = zlib.decompressobj(31), [], at
    try:
        while not z.eof and end < len(data):  # in steps: what follows the member is not copied whole
            plain.append(z.decompress(data[end : end + step]))
            end += step
    except zlib.error as e:
        raise ValueError(f"gzip: {e}"[:80]) from None
    if not z.eof:
        raise Short("gzip: member is cut off")
    return b"".join(plain), min(end, len(data)) - len(z.unused_data) - at


def _inside(plain: bytes) -> list[tuple[int, int, dict | str]]:
    """(offset, length, record or reason) of a member's bytes: its records, and the gaps between them."""
    out, at, gap, why = [], 0, None, ""
    while at < len(plain):
        try:
            record = parse_record(plain, at)
        except ValueError as e:
            if gap is None:
                gap, why = at, str(e)
            m = MARK.search(plain, at + 1)
            at = m.start() if m else len(plain)
            continue
        if gap is not None:
            out.append((gap, at - gap, why))
            gap = None
        out.append((at, record["size"], record))
        at += record["size"]
    if gap is not None:
        out.append((gap, len(plain) - gap, why))
    return out


def _take(data: bytes, at: int) -> tuple[list[tuple[int | None, dict | str]], int]:
    """What stands at ``at``, a member's records and gaps or a plain record, and its length."""
    if data[at : at + 3] != b"\x1f\x8b\x08":
        record = parse_record(data, at)
        return [(None, record)], record["size"]
    plain, size = _member(data, at)
    parts = _inside(plain)
    if not any(isinstance(x, dict) for _, _, x in parts):
        raise ValueError(parts[0][2] if parts else "empty member")
    return [(i, x) for i, _, x in parts], size


def salvage_stream(f: BinaryIO, step: int = 8 << 20) -> Iterator[Found]:
    """('record', offset, length, place in its member, fields) and ('gap', offset, length, place, reason) of an archive, in order.

    Records and gaps that stand on their own cover every byte of the archive once; a gap inside a member has length 0.
    """
    data, base, at, want, done = b"", 0, 0, 1 << 16, False
    gap, reason = None, ""
    while True:
        if len(data) - at < want and not done:
            more = f.read(max(step, want))
            done = not more
            data, base, at = data[at:] + more, base + at, 0
            continue
        if at >= len(data):
            break
        try:
            parts, size = _take(data, at)
        except ValueError as e:
            if isinstance(e, Short) and not done:
                want = max(want, len(data) - at) * 2
                continue
            if gap is None:
                gap, reason = base + at, str(e)
            want = 1 << 16
            m = MARK.search(data, at + 1)
            at = m.start() if m else len(data) if done else max(at + 1, len(data) - 5)  # a mark may be cut by the end
            continue
        if gap is not None:
            yield "gap", gap, base + at - gap, None, reason
            gap = None
        for i, (place, x) in enumerate(parts):
            yield "record" if isinstance(x, dict) else "gap", base + at, 0 if i else size, place, x
        at, want = at + size, 1 << 16
    if gap is not None:
        yield "gap", gap, base + len(data) - gap, None, reason


def salvage(data: bytes) -> Iterator[tuple[str, int, int, dict | str]]:
    """``salvage_stream`` of bytes, without the places inside members."""
    return ((kind, at, size, x) for kind, at, size, _, x in salvage_stream(io.BytesIO(data)))


def read_warc(manifest: DataFrame, payloads: bool = True) -> DataFrame:
    """Rows of kind ``record`` or ``gap`` of the files named in ``manifest.file``; schema ``RECORDS``."""
    spark: SparkSession = manifest.sparkSession

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for uri in pdf["file"]:
                fs, path = filesystem(uri)
                with fs.open_input_file(path) as f:
                    rows: list[dict] = []
                    held = 0
                    for kind, at, size, inside, x in salvage_stream(f):
                        row = {"file": uri, "offset": at, "length": size, "inside": inside, "kind": kind}
                        if kind == "gap":
                            rows.append(row | {"reason": x})
                        else:
                            x.pop("size")
                            held += len(x["payload"]) if payloads else 0
                            rows.append(row | x | ({} if payloads else {"payload": None}))
                        if len(rows) >= 4096 or held > 8 << 20:
                            yield _frame(rows)
                            rows, held = [], 0
                    if rows:
                        yield _frame(rows)

    n = max(1, min(manifest.count(), 4 * parallelism(spark)))
    return manifest.select("file").repartition(n).mapInPandas(read, RECORDS)


def _frame(rows: list[dict]) -> pd.DataFrame:
    names = [x.split()[0] for x in RECORDS.split(", ")]
    out = pd.DataFrame({n: pd.Series([r.get(n) for r in rows], dtype="object") for n in names})
    for n in ("payload_bytes", "inside"):
        out[n] = out[n].astype("Int64")
    return out
