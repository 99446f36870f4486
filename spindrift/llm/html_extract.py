"""HTML main-text extraction by a recurrent block labeller.

A page becomes its sequence of leaf blocks: runs of text between block-level tags, character references
decoded, white space folded; scripts, styles, comments and other non-text go in the parser. Each block gets a
vector: hashed tag-path features (all open tags with their class and id words, each tag also with its distance
from the leaf, 3 and more being one), all its words hashed, and a few counts. A bidirectional LSTM in numpy reads a page's vectors in order and
labels every block as main text or not with the whole document as context. The main blocks are joined by two
line breaks.

The weights (``html_weights.npz``) are trained by ``html_train.py`` on pages that a seeded generator makes.

Pages are labelled in batches of like length. A very long page is read in chunks of blocks, forwards and backwards, each
going on from the states the chunk before left: the labels are those of the whole page, and nothing is cut off.

Defined cases: null and empty html give an empty text; malformed markup is read as browsers' parsers would,
roughly: the head ends at the first tag or text that cannot stand in it, an unclosed script swallows the rest, stray closing tags are ignored; rows that repeat are extracted one by
one; an empty table gives an empty result; other columns are ignored unless in ``carry``.
"""

from __future__ import annotations

import functools
import math
import os
import re
from collections.abc import Iterator, Sequence
from html.parser import HTMLParser
from typing import NamedTuple
from zlib import crc32

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# HTML's tag classes.
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 "
    "head header hgroup hr html legend li main menu nav ol optgroup option p pre section select summary table tbody td tfoot th thead title tr ul".split()
)
SKIP = frozenset("script style noscript template iframe object svg math canvas audio video head title textarea".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
CLOSES_P = BLOCK - {"body", "html", "head", "option", "optgroup"}
IMPLIED = {"li": ("li",), "dd": ("dd", "dt"), "dt": ("dd", "dt"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
IN_HEAD = frozenset("base basefont bgsound head html link meta noframes noscript script style template title".split())
SCOPE = frozenset("html body article section div aside nav header footer main ul ol dl table form blockquote td th figure".split())

N_PATH, N_WORD, N_COUNT = 96, 32, 9
WIDTH = N_PATH + N_WORD + N_COUNT
SPACE = re.compile(r"\s+")
NAME = re.compile(r"[a-z]+")


@functools.lru_cache(1 << 16)
def _bit(name: str) -> int:
    return 1 << crc32(name.encode("utf-8", "surrogatepass")) % N_PATH


class Open(NamedTuple):
    """An open tag: the path features of it and all around it, as bits; ``far`` are those of its tags at distance 3 or more."""

    tag: str
    path: int
    far: int


class Block(NamedTuple):
    path: int
    depth: int
    leaf: str
    text: str
    links: int  # characters inside links


class BlockParser(HTMLParser):
    """Collects the leaf blocks."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.blocks: list[Block] = []
        self.stack: list[Open] = []
        self.pieces: list[str] = []
        self.links = self.skipped = self.in_link = 0

    def flush(self) -> None:
        if self.pieces:
            text = SPACE.sub(" ", "".join(self.pieces)).strip()
            if text:
                self.blocks.append(Block(self._path(), len(self.stack), self.stack[-1].tag if self.stack else "", text, self.links))
            self.pieces, self.links = [], 0

    def _path(self) -> int:
        path = self.stack[-1].path if self.stack else 0
        for up, x in enumerate(reversed(self.stack[-3:])):
            path |= _bit(f"t{x.tag}{up}")
        return path | (self.stack[-4].far if len(self.stack) > 3 else 0)

    def _pop(self, n: int) -> None:
        for tag, _, _ in self.stack[n:]:
            self.skipped -= tag in SKIP
            self.in_link -= tag == "a"
        del self.stack[n:]

    def _close(self, tags: Sequence[str], scope: frozenset) -> None:
        for i in range(len(self.stack) - 1, -1, -1):
            tag = self.stack[i].tag
            if tag in tags:
                return self._pop(i)
            if tag in scope:
                return None
        return None

    def _end_head(self) -> None:
        if self.stack and self.stack[-1].tag == "head":
            self._pop(len(self.stack) - 1)

    def handle_starttag(self, tag: str, attrs) -> None:
        if tag not in IN_HEAD:
            self._end_head()
        if tag in BLOCK:
            self.flush()
            if tag in CLOSES_P:
                self._close(("p",), SCOPE)
            if tag in IMPLIED:
                self._close(IMPLIED[tag], SCOPE - {"td", "th"} if tag == "tr" else SCOPE - set(IMPLIED[tag]))
        if tag == "br":
            self.pieces.append(" ")
        if tag in VOID:
            return
        words = [w for k, v in attrs if k in ("class", "id", "role") and v for w in NAME.findall(v.lower())]
        around = self.stack[-1] if self.stack else Open("", 0, 0)
        path = around.path | _bit(f"t{tag}")
        for w in words:
            path |= _bit(f"w{w}")
        self.stack.append(Open(tag, path, around.far | _bit(f"t{tag}3")))
        self.skipped += tag in SKIP
        self.in_link += tag == "a"
        if tag in SKIP and tag not in self.CDATA_CONTENT_ELEMENTS:
            self.flush()

    def handle_startendtag(self, tag: str, attrs) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag: str) -> None:
        for i in range(len(self.stack) - 1, -1, -1):
            if self.stack[i].tag == tag:
                if tag in BLOCK:
                    self.flush()
                return self._pop(i)
            if tag not in BLOCK and self.stack[i].tag in BLOCK and self.stack[i].tag != "p":
                return None
        return None

    def handle_data(self, data: str) -> None:
        if self.skipped and self.stack and self.stack[-1].tag == "head" and data.strip():
            self._end_head()
        if not self.skipped:
            self.pieces.append(data)
            if self.in_link:
                self.links += len(data.strip())


def blocks_of(html: str) -> list[Block]:
    parser = BlockParser()
    parser.feed(html)
    parser.close()
    parser.flush()
    return parser.blocks


def vectors(blocks: list[Block]) -> np.ndarray:
    x = np.zeros((len(blocks), WIDTH), np.float32)
    paths = b"".join(b.path.to_bytes(N_PATH // 8, "little") for b in blocks)
    x[:, :N_PATH] = np.unpackbits(np.frombuffer(paths, np.uint8).reshape(-1, N_PATH // 8), axis=1, bitorder="little")
    for i, (_, depth, leaf, text, links) in enumerate(blocks):
        n, low = len(text), text.lower()
        words = low.encode("utf-8", "surrogatepass").split(b" ")
        x[i, N_PATH : N_PATH + N_WORD] = np.bincount([crc32(w) % N_WORD for w in words], minlength=N_WORD) * (0.5 / math.sqrt(len(words)))
        x[i, N_PATH + N_WORD :] = (
            math.log1p(n) / 6,
            math.log1p(len(words)) / 5,
            min(1.0, links / max(1, n)),
            i / max(1, len(blocks) - 1),
            min(depth, 16) / 16,
            float(leaf in ("p", "b", "i", "em", "strong", "span", "blockquote", "pre")),
            float(leaf[:1] == "h" and leaf[1:].isdigit()),
            float(text[-1:] in ".!?…\"”"),
            float("©" in text or "cookie" in low),
        )
    return x


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def lstm(x: np.ndarray, mask: np.ndarray, w: np.ndarray, u: np.ndarray, b: np.ndarray, keep: list | None = None, state: tuple[np.ndarray, np.ndarray] | None = None) -> np.ndarray:
    """Hidden states (pages, blocks, hidden) of one direction; ``keep`` collects what training needs; ``state`` (h and c) is started from and updated."""
    pages, steps, _ = x.shape
    hidden = u.shape[0]
    h, c = state or (np.zeros((pages, hidden), np.float32), np.zeros((pages, hidden), np.float32))
    out = np.zeros((pages, steps, hidden), np.float32)
    drive = x @ w + b
    for t in range(steps):
        z = drive[:, t] + h @ u
        s = _sigmoid(z[:, : 3 * hidden])
        i, f, o, g = s[:, :hidden], s[:, hidden : 2 * hidden], s[:, 2 * hidden :], np.tanh(z[:, 3 * hidden :])
        m = mask[:, t : t + 1]
        c_new = f * c + i * g
        tc = np.tanh(c_new)
        if keep is not None:
            keep.append((h, c, i, f, o, g, tc, m))
        c = m * c_new + (1 - m) * c
        h = m * (o * tc) + (1 - m) * h
        out[:, t] = h
    if state:
        state[0][:], state[1][:] = h, c
    return out


class Labeller:
    """Input layer, two LSTMs, output unit."""

    NAMES = ("w0", "b0", "wf", "uf", "bf", "wb", "ub", "bb", "wo", "bo")

    def __init__(self, weights: dict[str, np.ndarray]):
        self.w = {k: np.asarray(weights[k], np.float32) for k in self.NAMES}

    def probabilities(self, pages: list[np.ndarray], window: int = 512) -> list[np.ndarray]:
        """Of each block; the pages in ascending length. Both directions go through the pages in chunks and hand their states on."""
        w, hidden = self.w, len(self.w["uf"])
        score = [np.full(len(x), w["bo"][0], np.float32) for x in pages]
        chunks = []  # first page that reaches it, first block, inputs, mask
        for s in range(0, len(pages[-1]), window):
            first = next(r for r, x in enumerate(pages) if len(x) > s)
            parts = [x[s : s + window] for x in pages[first:]]
            x = np.zeros((len(parts), len(parts[-1]), WIDTH), np.float32)
            mask = np.zeros(x.shape[:2], np.float32)
            for r, part in enumerate(parts):
                x[r, : len(part)], mask[r, : len(part)] = part, 1
            chunks.append((first, s, np.tanh(x @ w["w0"] + w["b0"]), mask))
        for d, turn in (("f", 1), ("b", -1)):
            h, c = np.zeros((len(pages), hidden), np.float32), np.zeros((len(pages), hidden), np.float32)
            out = w["wo"][:hidden] if d == "f" else w["wo"][hidden:]
            for first, s, e, mask in chunks[::turn]:
                states = lstm(e[:, ::turn], mask[:, ::turn], w[f"w{d}"], w[f"u{d}"], w[f"b{d}"], state=(h[first:], c[first:]))
                part = (states[:, ::turn] @ out)[:, :, 0]
                for r, row in enumerate(part):
                    own = score[first + r][s : s + window]
                    own += row[: len(own)]
        return [_sigmoid(x) for x in score]

    def label(self, pages: list[np.ndarray], window: int = 512, cells: int = 1 << 13) -> list[np.ndarray]:
        """Is each block main text? Pages of like length go together."""
        out = [np.zeros(len(x), bool) for x in pages]
        order = sorted(range(len(pages)), key=lambda k: len(pages[k]))
        while order:
            take = max(1, cells // max(1, min(len(pages[order[-1]]), window)))
            batch, order = order[-take:], order[:-take]
            for k, p in zip(batch, self.probabilities([pages[k] for k in batch], window)):
                out[k] = p > 0.5
        return out


@functools.cache
def labeller(path: str | None = None) -> Labeller:
    with np.load(path or os.path.join(os.path.dirname(__file__), "html_weights.npz")) as z:
        return Labeller(dict(z))


def main_texts(htmls: Sequence[str], model: Labeller | None = None) -> list[str]:
    """The main text of each page."""
    parsed = [blocks_of(h) for h in htmls]
    labels = (model or labeller()).label([vectors(b) for b in parsed])
    return ["\n\n".join(b.text for b, keep in zip(blocks, ks) if keep) for blocks, ks in zip(parsed, labels)]


def extract_main_text(df: DataFrame, html_col: str = "html", carry: Sequence[str] = ("page_id", "url"), group: int = 64) -> DataFrame:
    """The ``carry`` columns, text and n_chars (code points) of every row."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for i in range(0, len(pdf), group):
                part = pdf.iloc[i : i + group]
                texts = main_texts(part["_html"].tolist())
                yield part.drop(columns="_html").assign(_text=texts, _chars=[len(t) for t in texts])

    kinds = dict(df.dtypes)
    rows = df.select(*[F.col(c).cast("string").alias(f"_c{i}") for i, c in enumerate(carry)], F.coalesce(F.col(html_col), F.lit("")).alias("_html"))
    got = rows.mapInPandas(run, ", ".join([*[f"_c{i} string" for i in range(len(carry))], "_text string", "_chars long"]))
    return got.select(*[F.col(f"_c{i}").cast(kinds[c]).alias(c) for i, c in enumerate(carry)], F.col("_text").alias("text"), F.col("_chars").alias("n_chars"))
