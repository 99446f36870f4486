"""Toxicity: boosted trees over dense features of a text, calibrated by isotonic regression.

Features: densities of a small fixed lexicon and of one that is mined from training labels (words and word
beginnings that toxic training documents have many times more often), how near second-person
words stand to lexicon words, capitals, punctuation, symbols and obfuscation. A score sees the text
alone.

Training reads at most about ``max_train`` labelled documents, drawn by a hash of their ids from those whose
crc32(id) mod 5 is not 0; one part of them gives the lexicon, one the trees, one the calibration, so
no part is judged on what it has seen. Everything else covers all rows. The model is a few hundred
kilobytes and goes out with the tasks.

Defined cases: null and empty texts are scored like a text of no words; labels that are null are left out; no
labelled rows, or one class alone, give a constant score; rows that repeat an id are scored
one by one; other columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spindrift.llm.boosting import Boosted, Isotonic, fit_boosted, fit_isotonic
from spindrift.llm.common import staged, text_or_empty

# A starting lexicon of insults in four languages, and second-person words.
INSULTS = (
    "idiot moron stupid pathetic loser scum trash worthless disgusting clown dumb filthy hate kill "
    "arschloch dumm hure idiotisch abschaum widerlich connard salope imbécile abruti ordure idiota estúpido imbécil basura asqueroso"
).split()
SECOND = set("you your yours yourself u ur thou du dich dir dein deine ihr euch tu toi te ton ta vous votre tú ti tus usted ustedes vos".split())
LEET = str.maketrans("013457@$", "oieastas")
SYMBOLS = re.compile(r"[@#$%^&*~|\\<>=+]")
WORDS = re.compile(r"[\W\d_]+")
MIXED = re.compile(r"[^\W\d_]+(?:[\d@$*._\-]+[^\W\d_]+)+")
RUNS = re.compile(r"([!?.])\1+")
LONG = re.compile(r"([^\W\d_])\1\1")
STEMS = (4, 5, 6, 7)
NAMES = (
    "words hits density weight mean_weight fixed second proximity upper shouts exclaim question punct runs symbols mixed hidden long digits length"
).split()


@dataclass
class Lexicon:
    """Weights (log odds) of whole words and of word beginnings; finds them all in one pass."""

    words: dict[str, float] = field(default_factory=dict)
    stems: dict[str, float] = field(default_factory=dict)

    def __post_init__(self):
        self._automaton = None

    def __getstate__(self):
        return {"words": self.words, "stems": self.stems, "_automaton": None}

    def find(self, plain: str) -> list[tuple[int, float, bool]]:
        """(start, weight, fixed) of the words of ``plain`` (lower case, a space before and after each word) that it has."""
        if self._automaton is None:
            import ahocorasick

            a = ahocorasick.Automaton()
            for term, w in self.stems.items():
                a.add_word(f" {term}", (len(term), w, False))
            for term, w in self.words.items():
                a.add_word(f" {term} ", (len(term) + 1, w, False))
            for term in INSULTS:
                a.add_word(f" {term} ", (len(term) + 1, self.words.get(term, 0.0), True))
            a.make_automaton()
            self._automaton = a
        best: dict[int, tuple[float, bool]] = {}
        for end, (n, w, fixed) in self._automaton.iter(plain):
            at = end - n
            old = best.get(at, (0.0, False))
            best[at] = (max(w, old[0]), fixed or old[1])
        return [(at, w, fixed) for at, (w, fixed) in best.items()]


def plain_text(text: str) -> str:
    return f" {WORDS.sub(' ', text.lower()).strip()} "


def features(text: str, lexicon: Lexicon) -> list[float]:
    plain = plain_text(text)
    n, chars = max(1, plain.count(" ") - 1), max(1, len(text))
    found = lexicon.find(plain)
    mixed = MIXED.findall(text)
    hidden = []
    if mixed:
        undone = " " + "  ".join(re.sub(r"[\d*._\-]", "", m.lower().translate(LEET)) for m in mixed) + " "
        hidden = lexicon.find(undone)
    weights = [w for _, w, _ in found if w > 0] + [w for _, w, _ in hidden if w > 0]
    near = second = 0.0
    words = plain.split() if found else []
    if found:
        you = np.flatnonzero([w in SECOND for w in words])
        second = len(you) / n
        if len(you):
            at = np.array([plain.count(" ", 0, s) for s, _, _ in found])
            after = np.searchsorted(you, at)
            ahead, back = you[np.minimum(after, len(you) - 1)], you[np.maximum(after - 1, 0)]
            near = float(1 / (1 + np.minimum(np.abs(ahead - at), np.abs(back - at)).min()))
    upper = sum(map(str.isupper, text)) if not text.islower() else 0
    return [
        np.log1p(n),
        np.log1p(len(weights)),
        len(weights) / n,
        max(weights, default=0.0),
        sum(weights) / n,
        sum(f for _, _, f in found) / n,
        second,
        near,
        upper / chars,
        sum(w.isupper() and len(w) > 2 for w in text.split()) / n if upper > 0.1 * chars else 0.0,
        text.count("!") / n,
        text.count("?") / n,
        (text.count(".") + text.count(",") + text.count(";") + text.count(":")) / n,
        sum(1 for _ in RUNS.finditer(text)) / n,
        len(SYMBOLS.findall(text)) / n,
        len(mixed) / n,
        np.log1p(len(hidden)),
        sum(1 for _ in LONG.finditer(text)) / n,
        sum(text.count(d) for d in "0123456789") / n,
        chars / n,
    ]


@dataclass
class ToxicityModel:
    lexicon: Lexicon
    trees: Boosted
    calibrate: Isotonic
    constant: float | None = None

    def score(self, texts) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(texts), self.constant)
        x = np.array([features(t, self.lexicon) for t in texts]).reshape(-1, len(NAMES))
        return np.clip(self.calibrate(self.trees.raw(x)), 0.0, 1.0)


def remainder(id_col: str | Column) -> Column:
    """crc32 of the id as text, mod 5: 0 is held out."""
    c = F.col(id_col) if isinstance(id_col, str) else id_col
    return F.pmod(F.crc32(c.cast("string").cast("binary")), F.lit(5))


def _terms(plain: str) -> set[str]:
    """Words (with a trailing space) and their beginnings."""
    words = set(plain.split())
    return {w + " " for w in words} | {w[:k] for w in words for k in STEMS if len(w) > k}


def _frames(c: Counter[str], rows: int = 20_000) -> Iterator[pd.DataFrame]:
    """The counts so far, in small frames; empties the counter."""
    terms, n = list(c), list(c.values())
    c.clear()
    for i in range(0, len(terms), rows):
        yield pd.DataFrame({"term": pd.Series(terms[i : i + rows], dtype="object"), "n": n[i : i + rows]})


def _count(docs: DataFrame, label: int, only: set[str] | None) -> DataFrame:
    """How many of the training documents of a label have each term; ``only``: the terms to count."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        c: Counter[str] = Counter()
        for pdf in batches:
            for t in pdf["text"]:
                found = _terms(plain_text(t))
                c.update(found if only is None else found & only)
            if len(c) > 200_000:
                yield from _frames(c)
        yield from _frames(c)

    part = docs.filter((F.col("part") == 0) & (F.col("y") == label)).select("text")
    return part.mapInPandas(run, "term string, n long").groupBy("term").agg(F.sum("n").alias("n"))


def mine_lexicon(docs: DataFrame, toxic: int, clean: int, lift: float = 6.0, most: int = 4000) -> Lexicon:
    """Terms that at least max(4, 0.4 %) of the toxic and ``lift`` times fewer of the clean training documents have.

    At most ``most`` terms are kept, those with the largest log odds.
    """
    least = max(4, int(0.004 * toxic))
    mine = {r.term: r.n for r in _count(docs, 1, None).filter(F.col("n") >= least).orderBy(F.desc("n"), "term").limit(200_000).collect()}
    other = {r.term: r.n for r in _count(docs, 0, set(mine)).collect()} if mine else {}
    odds = {t: float(np.log((n + 0.5) / (toxic + 1)) - np.log((other.get(t, 0) + 0.5) / (clean + 1))) for t, n in mine.items()}
    good = sorted((t for t in odds if odds[t] >= np.log(lift)), key=lambda t: (-odds[t], t))[:most]
    return Lexicon({t[:-1]: odds[t] for t in good if t.endswith(" ")}, {t: odds[t] for t in good if not t.endswith(" ")})


def fit_toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", max_train: int = 20_000) -> ToxicityModel:
    """Fit lexicon, trees and calibration on about ``max_train`` labelled rows at most; held-out rows are never read."""
    usable = labels.filter(F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & (remainder(id_col) != 0))
    n = usable.count()
    share = min(1.0, max_train / max(1, n))
    drawn = F.pmod(F.xxhash64(F.col(id_col), F.lit("draw")), F.lit(1 << 20))
    few = usable.filter(drawn < int(share * (1 << 20))).groupBy(F.col(id_col).alias("_id")).agg(F.max(label_col).cast("int").alias("y"))
    # the drawn ids are at most about max_train rows of 12 bytes whatever the corpus, so they are broadcast
    picked = docs.select(F.col(id_col).alias("_id"), text_or_empty(text_col).alias("text")).join(F.broadcast(few), "_id")
    fold = F.pmod(F.xxhash64("_id", F.lit("fold")), F.lit(10))
    train = staged(picked.select("text", "y", F.when(fold < 4, 0).when(fold < 8, 1).otherwise(2).alias("part")), "toxicity-train")
    counts = {(r.part, r.y): r.n for r in train.groupBy("part", "y").agg(F.count(F.lit(1)).alias("n")).collect()}
    positive, total = sum(v for (_, y), v in counts.items() if y == 1), sum(counts.values())
    empty = Lexicon()
    if positive in (0, total):
        return ToxicityModel(empty, fit_boosted(np.zeros((0, len(NAMES))), np.zeros(0)), fit_isotonic(np.zeros(0), np.zeros(0)), positive / total if total else 0.0)
    lexicon = mine_lexicon(train, counts.get((0, 1), 0), counts.get((0, 0), 0))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"part": pdf["part"], "y": pdf["y"], "x": [features(t, lexicon) for t in pdf["text"]]})

    got = train.filter("part > 0").mapInPandas(run, "part int, y int, x array<double>").toPandas()
    x, y, part = np.array(got["x"].tolist()).reshape(-1, len(NAMES)), got["y"].to_numpy(), got["part"].to_numpy()
    order = np.lexsort((*x.T, y, part))  # tasks end in any order
    x, y, part = x[order], y[order], part[order]
    trees = fit_boosted(x[part == 1], y[part == 1])
    return ToxicityModel(lexicon, trees, fit_isotonic(trees.raw(x[part == 2]), y[part == 2]))


def score_toxicity(docs: DataFrame, model: ToxicityModel, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """id, score and the ``carry`` columns of every row."""
    rows = docs.select(F.col(id_col), text_or_empty(text_col).alias("_text"), *[F.col(c).alias(f"_c_{c}") for c in carry])

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        return pd.Series(model.score(texts))

    return rows.select(id_col, score("_text").alias("score"), *[F.col(f"_c_{c}").alias(c) for c in carry])
