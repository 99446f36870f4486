"""Forms and sizes that an operator once left out."""

from __future__ import annotations


def test_pii_proposes_every_form_its_generators_match():
    from spindrift.llm.pii import GENERATORS, candidates, redactor

    texts = ["write to anna.berg(at)example.com", "mail name [at] site.org now", "contact: name at site.com", "server ::1", "host fe80::1 is up", "ip 2001:db8::1", "address dead:beef::cafe", "abcd:ef::ab:cd:ef:ab"]
    for t in texts:
        want = {(kind, *m.span(group)) for kind, _, pattern, group in GENERATORS for m in pattern.finditer(t)}
        assert want and set(candidates(t)) == want
        assert set(candidates(t + " \n@ dot 7")) >= want  # nothing elsewhere in the text matters
    spans = lambda t: [t[a:b] for _, a, b in redactor().spans(t)[1]]
    assert [spans(t) for t in texts[:3]] == [["anna.berg(at)example.com"], ["name [at] site.org"], ["name at site.com"]]
    assert [spans(t) for t in texts[4:6]] == [["fe80::1"], ["2001:db8::1"]]
    for t in ("available at github.com", "visit us at example.org", "std::bad::face a::b", "look 12::30"):
        assert spans(t) == []


def test_html_long_pages_are_labelled_as_a_whole():
    """A model whose labels hang on a page's first and last block only."""
    import numpy as np

    from spindrift.llm.html_extract import WIDTH, Labeller, labeller

    w = {"w0": np.zeros((WIDTH, 2)), "b0": np.zeros(2), "wo": np.full((2, 1), 10.0), "bo": np.array([-12.0])}
    w["w0"][0, 0] = w["w0"][1, 1] = 9
    for at, d in enumerate("fb"):  # gates i, f, o, and g: a cell that takes its input's mark once and keeps it
        w |= {f"w{d}": np.zeros((2, 4)), f"u{d}": np.zeros((1, 4)), f"b{d}": np.array([-20.0, 25, 25, 5])}
        w[f"w{d}"][at, 0] = 40
    pages = []
    for n, marks in ((2000, (0, 1)), (3, (0, 1)), (700, (0,)), (0, ()), (512, (0, 1)), (513, (0, 1)), (1100, (1,)), (1500, (0, 1))):
        x = np.zeros((n, WIDTH), np.float32)
        for m in marks:
            x[-m, m] = 1
        pages.append(x)
    assert [(len(y), bool(y.all()), bool(y.any())) for y in Labeller(w).label(pages)] == [
        (2000, True, True), (3, True, True), (700, False, False), (0, True, False), (512, True, True), (513, True, True), (1100, False, False), (1500, True, True)
    ]
    rng = np.random.default_rng(0)
    x = [(rng.random((n, WIDTH)) < 0.1).astype(np.float32) for n in (40, 900, 1300)]
    assert all(np.allclose(a, b, atol=1e-5) for a, b in zip(labeller().probabilities(x), labeller().probabilities(x, 5000)))


def test_decontamination_finds_the_best_of_all_starts(spark):
    import random

    from spindrift.llm.decontaminate import contaminated

    r = random.Random(5)
    item = [f"w{i}" for i in range(60)]

    def best(v):
        a, got = {tuple(item[p : p + 5]) for p in range(56)}, []
        for s in range(max(1, len(v) - 59)):
            b = [tuple(v[p : p + 5]) for p in range(s, min(s + 60, len(v)) - 4)]
            both = len(a & set(b))
            got.append((both / (56 + len(b) - both), -s))
        return max(got)

    docs, want = [], {}
    for d in range(60):
        copy = ["x", *item[1:-1], "y"] if d % 2 else list(item)
        for _ in range(2 if d < 30 else r.randint(0, 4)):
            at = r.randint(28, 30) if d < 30 else r.randrange(len(copy))
            copy.insert(at, f"new{at}")
        own = [f"o{d}x{i}" for i in range(r.choice((0, 3, 80)))]
        v = own + copy + own[: r.choice((0, 2, 80))]
        docs.append((d, " ".join(v)))
        similarity, start = best(v)
        if similarity >= 0.8:
            want[d] = (round(similarity, 9), -start)
    dd = spark.createDataFrame(docs, "doc_id long, text string")
    ii = spark.createDataFrame([(1, " ".join(item))], "item_id long, text string")
    got = {x.doc_id: (round(x.similarity, 9), x.start) for x in contaminated(dd, ii).collect()}
    assert got == want and 20 < len(want) < 60


def test_toxicity_looks_for_a_second_person_near_every_hit():
    from spindrift.llm.toxicity import Lexicon, features

    filler = "idiot " + "word " * 5
    near = 7  # its place among the features
    for text, want in ((filler * 1500 + "you idiot", 1 / 2), ("you " + "word " * 9 + filler * 3, 1 / 11), (filler * 1100 + "word you word " + filler, 1 / 3), (filler * 2000, 0.0)):
        assert abs(features(text, Lexicon())[near] - want) < 1e-9


def test_decontamination_finds_a_window_no_shared_shingle_is_aligned_in(spark):
    """An item of 112 words with two words replaced and eight put in: only one start reaches the threshold."""
    from spindrift.llm.decontaminate import contaminated

    item = [f"w{i}" for i in range(112)]
    copy = list(item)
    copy[3], copy[108] = "x", "y"
    copy[56:56] = [f"n{i}" for i in range(8)]
    text = [f"a{i}" for i in range(30)] + copy + [f"b{i}" for i in range(30)]
    docs = spark.createDataFrame([(1, " ".join(text)), (2, " ".join(item))], "doc_id long, text string")
    got = {r.doc_id: (r.similarity, r.start) for r in contaminated(docs, spark.createDataFrame([(7, " ".join(item))], "item_id long, text string")).collect()}
    a, best = {tuple(item[p : p + 5]) for p in range(108)}, []
    for s in range(len(text) - 111):
        both = len(a & {tuple(text[p : p + 5]) for p in range(s, s + 108)})
        best.append((both / (216 - both), -s))
    assert got == {1: (max(best)[0], -max(best)[1]), 2: (1.0, 0)} and max(best)[0] >= 0.8


def test_decontamination_recall_of_edited_copies(spark):
    """Random edits: of what all starts and items give, the fingerprints' radius loses (almost) nothing."""
    import random

    from spindrift.llm.decontaminate import contaminated

    r = random.Random(11)
    items = {i: [f"w{r.randrange(900)}" for _ in range(r.randint(14, 60))] for i in range(40)}
    docs, want = {}, {}
    for d in range(400):
        i = r.randrange(40)
        copy = list(items[i])
        for _ in range(r.randint(0, 3)):
            at = r.randrange(len(copy))
            copy[at : at + r.choice((0, 1))] = r.choice(([f"e{d}"], [], [f"e{d}"]))
        docs[d] = [f"o{d}x{j}" for j in range(r.randint(0, 40))] + copy + [f"p{d}x{j}" for j in range(r.randint(0, 40))]
        v, a = docs[d], {tuple(items[i][p : p + 5]) for p in range(len(items[i]) - 4)}
        for s in range(max(1, len(v) - len(items[i]) + 1)):
            b = {tuple(v[p : p + 5]) for p in range(s, min(s + len(items[i]), len(v)) - 4)}
            if a and len(a & b) / max(1, len(a | b)) >= 0.8:
                want[d, i] = True
    dd = spark.createDataFrame([(d, " ".join(v)) for d, v in docs.items()], "doc_id long, text string")
    ii = spark.createDataFrame([(i, " ".join(v)) for i, v in items.items()], "item_id long, text string")
    got = {(x.doc_id, x.item_id) for x in contaminated(dd, ii).collect()}
    assert got <= want.keys() and len(got) >= 0.98 * len(want) and len(want) > 150


def test_token_workers_memory_follows_batch_and_memo():
    """Batches of 8 MB with 120,000 words each that the memo lacks: beyond what an encoder weighs, a worker stays under 140 MB."""
    import os
    import subprocess
    import sys

    code = """
import re
import pyarrow as pa
from spindrift.llm.queries import tokenizer_path
from spindrift.llm.tokens import encoder

most = lambda: int(re.search(r"VmHWM:\\s+(\\d+)", open("/proc/self/status").read())[1]) >> 10
enc = encoder(tokenizer_path())
enc.encode("a")
before = most()
name = lambda n: "".join(chr(97 + n // 26**k % 26) for k in range(5))
for batch in range(6):
    words = [name(7919 * (120_000 * batch + n)) for n in range(120_000)]
    text = " ".join([" ".join(words), *["some common words of a text,"] * 250_000])[: 8 << 20]
    texts = pa.array([text[i : i + 2000] for i in range(0, len(text), 2000)])
    del words, text
    ids, counts = enc.encode_batch(texts)
    assert len(counts) == len(texts) and counts.sum() == len(ids)
    if batch == 0:
        want = enc.tokenizer.encode_batch([texts[0].as_py(), texts[-1].as_py()], add_special_tokens=False)
        assert ids[: counts[0]].tolist() == want[0].ids and ids[len(ids) - counts[-1] :].tolist() == want[1].ids
print(most() - before)
"""
    repo = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    done = subprocess.run([sys.executable, "-c", code], cwd=repo, capture_output=True, text=True, timeout=300)
    assert done.returncode == 0, done.stderr
    assert int(done.stdout) < 140, done.stdout
