"""The pipeline's stages: on the smallest tables against brute force, and on hostile small fixtures."""

from __future__ import annotations

import pytest

from test_bruteforce import brute_components, slow_fingerprint
from test_models import slow_contaminated

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def cp():
    import corpus_pipeline

    return corpus_pipeline


@pytest.fixture
def hostile(spark):
    base = "alpha beta gamma delta epsilon zeta eta theta iota kappa "
    rows = [
        (7, base + "one", "en", "a", 1), (7, "completely other words stand in this text of the same number", "en", "a", 1),  # unlike rows that share an id
        (None, base + "one", None, None, None), (9, base + "one", "en", "b", 1), (7, base + "one", "en", "a", 1),  # copies, one without an id, one repeated row
        (None, "a text that only a row without an id has, and nothing else", None, "", 3), (3, None, None, None, None), (4, "", "de", "c", 0),
        (5, "long " * 40_000 + "tail", "en", None, 1),
    ]
    return spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 as _row", "2 as component_id", "3 as score")


def _rows(df):
    return sorted(((r.doc_id, r.text) for r in df.collect()), key=str)


def test_stages_on_the_smallest_tables(spark, cp):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = docs
    for name, stage in cp.STAGES[:-1]:
        before, texts = {r.doc_id for r in kept.select("doc_id").collect()}, [(r.doc_id, r.text) for r in kept.collect()]
        done = cp.staged(stage(spark, kept, SF), "test")
        assert sorted(done.columns) == sorted(docs.columns)
        ids = {r.doc_id for r in done.select("doc_id").collect()}
        if name == "toxicity":
            model = cp.fit_toxicity(kept, cp.table(spark, SF, "labels"))
            assert ids == {i for (i, t), s in zip(texts, model.score([t or "" for _, t in texts])) if s < 0.5}
        elif name == "simhash near-dedup":
            assert ids == set(brute_components({i: slow_fingerprint(t or "") for i, t in texts}).values()) and done.count() == len(ids)
        elif name == "benchmark decontamination":
            items = [(r.item_id, r.text) for r in cp.table(spark, SF, "benchmark").collect()]
            assert ids == before - {d for d, _ in slow_contaminated(texts, items)}
        else:
            assert ids == before
        kept = done
    out = cp.STAGES[-1][1](spark, kept, SF).collect()
    assert len(out) == kept.count() and {r.doc_id for r in out} == ids


def test_near_dedup_keeps_unlike_rows(spark, cp, hostile):
    got = _rows(cp.near_dedup(spark, hostile, SF))
    texts = {r.text for r in hostile.collect()}
    one = [t for _, t in got if t and t.endswith(" one")]
    assert len(one) == 1 and (7, one[0]) in got  # the smallest id of the copies, once
    assert {t or "" for _, t in got} == {t or "" for t in texts}  # no other text is lost
    assert [i for i, t in got if not t] == [3]
    assert _rows(cp.near_dedup(spark, hostile, SF)) == got


def test_toxicity_without_two_classes_keeps_all(spark, cp, hostile, tmp_path):
    for name, labels in (("none", []), ("one", [(7, 1, 1), (9, 1, 1), (5, 0, 1), (4, 1, None)])):
        spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/{name}/labels.parquet")
        out = cp.toxicity(spark, hostile, f"{tmp_path}/{name}")
        assert out.columns == list(cp.COLUMNS) and _rows(out) == _rows(hostile)


def test_decontamination_drops_rows_not_ids(spark, cp, hostile, tmp_path):
    spark.createDataFrame([(1, "alpha beta gamma delta epsilon zeta eta theta iota kappa one"), (2, None), (3, "a text that only a row without an id has, and nothing else")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = _rows(cp.decontamination(spark, hostile, str(tmp_path)))
    assert got == [x for x in _rows(hostile) if not (x[1] or "").endswith((" one", "nothing else"))] and len(got) == 4


def test_mixing_and_tokens_take_every_row(spark, cp, hostile):
    mixed = cp.staged(cp.mixing(spark, hostile, SF), "test")
    assert mixed.columns == list(cp.COLUMNS) and set(_rows(mixed)) == set(_rows(hostile)) and mixed.count() >= hostile.count()
    out = cp.token_output(spark, mixed, SF).orderBy("start").collect()
    assert len(out) == mixed.count() and [r.start for r in out] == [sum(x.n_tokens for x in out[:i]) for i in range(len(out))]


def test_stages_of_empty_tables(spark, cp, hostile, tmp_path):
    for name, schema in (("labels", "doc_id long, quality int, toxic int"), ("benchmark", "item_id long, text string")):
        spark.createDataFrame([], schema).write.parquet(f"{tmp_path}/{name}.parquet")
    for _, stage in cp.STAGES:
        assert stage(spark, hostile.limit(0), str(tmp_path)).count() == 0
    hostile.limit(0).select(*cp.COLUMNS).write.parquet(f"{tmp_path}/documents.parquet")
    assert cp.run(spark, str(tmp_path)).count() == 0
