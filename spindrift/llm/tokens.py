"""Token-ID output: bit-plane shuffled, zstandard-compressed blocks of token ids with a chunk index.

File format (``.bpt``): the magic ``BPT1``; then chunks; then the index; then a footer of 16 bytes (index
offset as u64, index length as u32, ``BPT1``). A chunk holds up to ``block`` ids of the file's stream as
unsigned 32-bit integers, transposed into 4 byte planes (or 32 bit planes), each plane compressed with
zstandard on its own; planes of zero bytes only cost a few bytes. The index is zstandard-compressed
JSON: plane kind, block size, and for each chunk its offset, ids and plane lengths; for each document its
id and token count, in stream order.

Order: documents are range-partitioned and sorted by id (ties by a hash of the text, so that rows of one id can be
split as well), so files follow each other in ascending id order, and each file's base offset is a running sum over
the manifest, one row a file, in blocks of partitions.

Encoding is exact but memoised: the tokenizer never lets a token span white space, so each distinct
word is encoded once by the tokenizers library and kept in a bounded memo. What a worker holds beside a batch's words and
ids, and the memo, is bounded by runs: texts are cut, words go to the library and pieces are put together a run at a time.

Defined cases: a null text is empty, and an empty text is the end id alone; a null id sorts first; rows that repeat an
id are written one after another; an empty table writes nothing and reads back no rows; other columns
are ignored.
"""

from __future__ import annotations

import json
import os
import re
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spindrift.llm.common import filesystem, fresh_dir, parallelism, staged

MAGIC = b"BPT1"
MANIFEST = "file string, part int, seq int, docs long, ids long, bytes long"
# Letters whose lower case and composition raise no questions (below U+0250, without dotted capital i), and ASCII marks but the apostrophe.
_SIMPLE = r"^(?P<stem>[A-Za-z\x{C0}-\x{D6}\x{D8}-\x{F6}\x{F8}-\x{12F}\x{131}-\x{24F}]+)(?P<tail>[!-&(-/:-@\[-`{-~]{0,3})$"


#: Pieces put together, and words given to the library, at a time; bytes of text cut into words at a time (whole texts).
RUN = 1 << 14
RUN_BYTES = 2 << 20


def _gather(arena: np.ndarray, start: np.ndarray, size: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(the pieces ``which`` of the arena, one after another; where each ends, with a leading 0); index arrays are of one run only."""
    ends = np.zeros(len(which) + 1, np.int64)
    np.cumsum(size[which], out=ends[1:])
    out = np.empty(ends[-1], arena.dtype)
    for i in range(0, len(which), RUN):
        w, e = which[i : i + RUN], ends[i : i + RUN + 1]
        out[e[0] : e[-1]] = arena[np.repeat(start[w] - e[:-1], size[w]) + np.arange(e[0], e[-1])]
    return out, ends


class WordEncoder:
    """Encoding of whole batches of texts by their words, with a bounded memo of word -> ids in flat arrays.

    The tokenizer never joins across white space, so a text's ids are those of its words, one after another. A
    batch is cut at ASCII white space and its distinct words are looked up together; a word that the memo lacks goes
    to the library. Where the file's pipeline lower-cases and takes runs of letters as words in the byte alphabet, a Latin
    word is looked up as its lower-cased letters and its closing marks, and letters that are missing go as ready
    pieces for its model, many at once; every other word goes through the file's own pipeline as it is.
    """

    def __init__(self, path: str, limit: int = 40 << 20):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.limit = limit
        said = json.loads(self.tokenizer.to_str())
        self.simple = self._lowercased_words(said)
        if self.simple:
            said |= {"normalizer": None, "pre_tokenizer": {"type": "WhitespaceSplit"}, "added_tokens": [], "post_processor": None}
            self.pieces = Tokenizer.from_str(json.dumps(said))
            vocab = self.tokenizer.get_vocab()
            self.last = np.zeros(max(vocab.values()) + 1, bool)
            self.last[[i for t, i in vocab.items() if t.endswith("</w>")]] = True
        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
        other = [b for b in range(256) if b not in set(printable)]
        self.alphabet = {b: chr(b) for b in printable} | {b: chr(256 + i) for i, b in enumerate(other)} | {32: " "}
        self._forget()

    def _forget(self) -> None:
        self.words, self.ids = pa.array([""], pa.large_string()), np.zeros(0, "<u4")
        self.start, self.size = np.zeros(1, np.int64), np.zeros(1, np.int64)

    @staticmethod
    def _lowercased_words(said: dict) -> bool:
        steps = [x["type"] for x in (said.get("normalizer") or {}).get("normalizers", [])]
        split = (said.get("pre_tokenizer") or {}).get("pretokenizers", [])
        return (
            steps == ["NFC", "Replace", "Lowercase"]
            and [x["type"] for x in split] == ["Split", "ByteLevel"]
            and "|[\\p{L}]+|" in str(split[0]["pattern"].get("Regex"))
            and said["model"].get("end_of_word_suffix") == "</w>"
        )

    def _by_own(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids, number of ids of each word) by the file's own pipeline, a word at a time."""
        got = [np.asarray(e.ids, "<u4") for e in self.tokenizer.encode_batch_fast(words.to_pylist(), add_special_tokens=False)]
        return np.concatenate(got), np.fromiter(map(len, got), np.int64, len(got))

    def _by_letters(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The same of lower-cased letters as pieces of the model, all at once."""
        mapped = " ".join(words.to_pylist()).encode().decode("latin1").translate(self.alphabet)
        ids = np.asarray(self.pieces.encode_batch_fast([mapped], add_special_tokens=False)[0].ids, "<u4")
        ends = np.flatnonzero(self.last[ids]) + 1
        if len(ends) != len(words):  # some piece has no closing token of its own
            return self._by_own(words)
        return ids, np.diff(ends, prepend=0)

    def _learn(self, words: pa.Array, by) -> None:
        """Append words to the memo, a run at a time through the library."""
        got = [by(words.slice(i, RUN)) for i in range(0, len(words), RUN)]
        size = np.concatenate([n for _, n in got])
        self.words = pa.concat_arrays([self.words, words])
        self.start = np.concatenate([self.start, len(self.ids) + np.cumsum(size) - size])
        self.size = np.concatenate([self.size, size])
        self.ids = np.concatenate([self.ids, *[x for x, _ in got]])

    def _places(self, keys: pa.Array, by) -> np.ndarray:
        """Where the memo has the keys; it learns those that it lacks. What is hashed are the keys, not the memo."""
        coded = keys.dictionary_encode()
        known = pc.index_in(self.words, value_set=coded.dictionary)
        at = np.flatnonzero(known.is_valid().to_numpy(zero_copy_only=False))
        place = np.full(len(coded.dictionary), -1, np.int64)
        place[known.drop_null().to_numpy()] = at
        new = place < 0
        if new.any():
            place[new] = len(self.words) + np.arange(new.sum())
            self._learn(coded.dictionary.filter(pa.array(new)), by)
        return place[coded.indices.to_numpy()]

    def encode_batch(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(all ids, number of ids of each text)."""
        got = list(self.encode_runs(texts))
        return np.concatenate([x for x, _ in got]), np.concatenate([n for _, n in got])

    def encode_runs(self, texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """The same of one run of texts after another."""
        size = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        cuts = np.flatnonzero(np.diff((np.cumsum(size) - size) // RUN_BYTES)) + 1
        bounds = [0, *cuts.tolist(), len(texts)]
        for a, b in zip(bounds, bounds[1:]):
            yield self._encode_run(texts.slice(a, b - a))
        pa.default_memory_pool().release_unused()

    def _encode_run(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        if self.words.nbytes + self.ids.nbytes + 16 * len(self.words) > self.limit:
            self._forget()
        split = pc.ascii_split_whitespace(texts.cast(pa.large_string()))
        offsets, coded = split.offsets.to_numpy(), split.flatten().dictionary_encode()
        del split  # the words once each are enough
        distinct, word = coded.dictionary, coded.indices.to_numpy(zero_copy_only=False)
        if self.simple:
            parts = pc.extract_regex(distinct, _SIMPLE)
            odd = parts.is_null().to_numpy(zero_copy_only=False)
            stems, tails = (pc.fill_null(pc.struct_field(parts, k), "") for k in ("stem", "tail"))
        else:
            odd = np.ones(len(distinct), bool)
            stems = tails = pa.array([""] * len(distinct), pa.large_string())
        first = self._places(pc.utf8_lower(stems), self._by_letters)
        first[odd] = self._places(distinct.filter(pa.array(odd)), self._by_own)
        second = self._places(tails, self._by_own)
        arena, ends = _gather(self.ids, self.start, self.size, np.stack([first, second], axis=1).ravel())
        ends = ends[::2]
        ids, ends = _gather(arena, ends[:-1], np.diff(ends), word)
        return ids, np.diff(ends[offsets - offsets[0]])

    def encode(self, text: str) -> bytes:
        """One text's ids, little-endian."""
        return self.encode_batch(pa.array([text]))[0].tobytes()


_ENCODERS: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    """The worker's encoder; it outlives tasks with the worker."""
    if path not in _ENCODERS:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core; each thread would hold memory of its own
        _ENCODERS[path] = WordEncoder(path)
    return _ENCODERS[path]


def pack_planes(ids: bytes, bits: bool = False) -> list[bytes]:
    """The planes of a block of little-endian u32 ids, each compressed."""
    import zstandard

    a = np.frombuffer(ids, np.uint8).reshape(-1, 4)
    planes = np.unpackbits(a, axis=1, bitorder="little").T if bits else a.T
    c = zstandard.ZstdCompressor(level=1)
    return [c.compress((np.packbits(p) if bits else np.ascontiguousarray(p)).tobytes()) for p in planes]


def unpack_planes(planes: list[bytes], n: int, bits: bool = False) -> bytes:
    import zstandard

    d = zstandard.ZstdDecompressor()
    raw = [np.frombuffer(d.decompress(p, max_output_size=max(1, n)), np.uint8) for p in planes]
    if bits:
        return np.packbits(np.stack([np.unpackbits(p, count=n) for p in raw], axis=1), axis=1, bitorder="little").tobytes()
    return np.stack(raw, axis=1).tobytes()


class PlaneWriter:
    """Writes one ``.bpt`` file to an open sink; holds one block of ids in memory."""

    def __init__(self, sink, block: int, bits: bool):
        self.sink, self.block, self.bits = sink, block, bits
        self.held, self.at, self.chunks, self.ids, self.docs, self.counts = bytearray(), 4, [], 0, [], []
        sink.write(MAGIC)

    def add(self, doc_id: str | None, ids: bytes) -> None:
        self.docs.append(doc_id)
        self.counts.append(len(ids) // 4)
        self.ids += len(ids) // 4
        self.held += ids
        while len(self.held) >= 4 * self.block:
            self._flush(bytes(self.held[: 4 * self.block]))
            del self.held[: 4 * self.block]

    def _flush(self, ids: bytes) -> None:
        planes = pack_planes(ids, self.bits)
        for p in planes:
            self.sink.write(p)
        self.chunks.append([self.at, len(ids) // 4, [len(p) for p in planes]])
        self.at += sum(map(len, planes))

    def close(self) -> int:
        import zstandard

        if self.held:
            self._flush(bytes(self.held))
        index = zstandard.ZstdCompressor(level=1).compress(
            json.dumps({"planes": "bits" if self.bits else "bytes", "block": self.block, "chunks": self.chunks, "docs": self.docs, "counts": self.counts}).encode()
        )
        self.sink.write(index + struct.pack("<QI", self.at, len(index)) + MAGIC)
        self.sink.close()
        return self.at + len(index) + 16


class PlaneReader:
    """Random access to a ``.bpt`` file by its chunk index."""

    def __init__(self, source):
        import zstandard

        size = source.size()
        source.seek(size - 16)
        at, n, magic = struct.unpack("<QI4s", source.read(16))
        if magic != MAGIC:
            raise ValueError("not a token file, or cut off")
        source.seek(at)
        self.source, self.index = source, json.loads(zstandard.ZstdDecompressor().decompress(source.read(n)))

    def chunk(self, k: int) -> bytes:
        at, n, lengths = self.index["chunks"][k]
        self.source.seek(at)
        data, planes = self.source.read(sum(lengths)), []
        for x in lengths:
            planes.append(data[:x])
            data = data[x:]
        return unpack_planes(planes, n, self.index["planes"] == "bits")

    def documents(self) -> Iterator[tuple[str | None, int, Iterator[bytes]]]:
        """(id, tokens, pieces of its ids) in stream order; the pieces must be taken before going on."""
        held, k = b"", 0

        def take(n: int) -> Iterator[bytes]:
            nonlocal held, k
            while n:
                if not held:
                    held, k = self.chunk(k), k + 1
                piece, held = held[:n], held[n:]
                n -= len(piece)
                yield piece

        for doc_id, n in zip(self.index["docs"], self.index["counts"]):
            yield doc_id, n, take(4 * n)


def write_tokens(
    df: DataFrame,
    tokenizer: str,
    end_id: int = 1,
    out_dir: str | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
    block: int = 1 << 16,
    bits: bool = False,
    roll_ids: int = 8 << 20,
    partition_bytes: int = 256 << 20,
    batch_bytes: int = 8 << 20,
) -> DataFrame:
    """Encode and write every row in ascending id order; returns the manifest, a row a file, staged.

    The manifest carries ``base``, the ids before the file. Partitions follow the total text size, so
    a task's work stays the same at any scale.
    """
    spark = df.sparkSession
    out_dir = (out_dir or fresh_dir(spark, "tokens")).rstrip("/")
    rows = df.select(F.col(id_col).cast("long").alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    size = rows.agg(F.sum(F.octet_length("_text"))).first()[0] or 0
    parts = max(parallelism(spark), int(size // partition_bytes) + 1)
    order = [F.col("_id").asc_nulls_first(), F.col("_h")]
    ordered = rows.withColumn("_h", F.xxhash64("_text")).repartitionByRange(parts, *order).sortWithinPartitions(*order, "_text")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = filesystem(out_dir)
        fs.create_dir(root, recursive=True)
        enc, end = encoder(tokenizer), struct.pack("<I", end_id)
        out, name, seq = None, "", 0

        def done(part: int) -> pa.RecordBatch:
            size = out.close()
            return pa.RecordBatch.from_pydict({"file": [f"{out_dir}/{name}"], "part": pa.array([part], pa.int32()), "seq": pa.array([seq], pa.int32()), "docs": [len(out.docs)], "ids": [out.ids], "bytes": [size]})

        for batch in _pieces(batches, batch_bytes):
            part = batch["_part"][0].as_py()
            doc_ids = iter(batch["_id"].to_pylist())
            for ids, counts in enc.encode_runs(batch["_text"]):
                data, at = ids.astype("<u4", copy=False).tobytes(), 0
                for n, doc_id in zip(counts.tolist(), doc_ids):
                    if out is None:
                        name = f"{uuid.uuid4().hex}.bpt"
                        out = PlaneWriter(fs.open_output_stream(f"{root}/{name}", compression=None), block, bits)
                    out.add(doc_id, data[at : at + 4 * n] + end)
                    at += 4 * n
                    if out.ids >= roll_ids:
                        yield done(part)
                        out, seq = None, seq + 1
        if out is not None:
            yield done(part)

    written = staged(
        ordered.select(F.spark_partition_id().alias("_part"), F.col("_id").cast("string"), "_text").mapInArrow(write, MANIFEST), "token-files"
    )
    # a running sum in two steps: inside blocks of 1024 partitions, and over the blocks
    blocks = written.withColumn("_block", F.floor(F.col("part") / 1024))
    before = F.coalesce(F.sum("ids").over(Window.partitionBy("_block").orderBy("part", "seq").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0).cast("long"))
    first = F.coalesce(F.sum("_all").over(Window.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0).cast("long"))
    totals = blocks.groupBy("_block").agg(F.sum("ids").alias("_all")).select("_block", first.alias("_first"))
    based = blocks.withColumn("_before", before).join(totals, "_block")
    return staged(based.select(*written.columns, (F.col("_before") + F.col("_first")).alias("base")), "token-manifest")


def _pieces(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about ``most`` bytes, whole rows each."""
    held, size = [], 0
    for batch in batches:
        at = 0
        while at < batch.num_rows:
            n = batch.num_rows - at
            while n > 1 and _bytes(batch, at, n) > most:
                n = (n + 1) // 2
            held.append(batch.slice(at, n))
            size += _bytes(batch, at, n)
            at += n
            if size >= most:
                yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                held, size = [], 0
    if size or held:
        yield from pa.Table.from_batches(held).combine_chunks().to_batches()


def _bytes(batch: pa.RecordBatch, at: int, n: int) -> int:
    return pc.sum(pc.binary_length(batch["_text"].slice(at, n))).as_py() or 0


def read_tokens(manifest: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of each document, read from the files of a manifest."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for uri, base in zip(pdf["file"], pdf["base"]):
                fs, path = filesystem(uri)
                with fs.open_input_file(path) as f:
                    rows, start = [], int(base)
                    for doc_id, n, pieces in PlaneReader(f).documents():
                        crc = 0
                        for p in pieces:
                            crc = zlib.crc32(p, crc)
                        rows.append((doc_id, start, n, crc))
                        start += n
                    for i in range(0, len(rows), 20_000):
                        yield pd.DataFrame(rows[i : i + 20_000], columns=["doc_id", "start", "n_tokens", "ids_crc32"])

    n = max(1, min(manifest.count(), 4 * parallelism(manifest.sparkSession)))
    out = manifest.select("file", "base").repartition(n).mapInPandas(read, "doc_id string, start long, n_tokens long, ids_crc32 long")
    return out.withColumn("doc_id", F.col("doc_id").cast("long"))
