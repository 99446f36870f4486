"""From raw documents to token files: a pipeline of five operators.

Each stage takes (spark, docs, sf_dir), works on all that the stage before kept, and returns the columns of
documents; the last returns a row for each document written. ``run`` writes every stage to the shared folder as
Parquet and reads it back for the next, so a lost executor costs a stage's tasks at most.

Stages decide by rows, not by ids: a row is told by a hash of all its columns, so rows that share an id but not their
text, or have no id, are documents of their own. Defined cases: null and empty texts are empty documents (one of them stays
after near-dedup); of a group of near-duplicates the row with the smallest id stays (null ids last, ties by the hash), once
if it is repeated; without labels, or with labels of one class alone, nothing can be told apart and toxicity keeps all;
empty tables give empty results; columns beside those of documents are dropped.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spindrift.llm.common import bounded_batches, staged, table
from spindrift.llm.decontaminate import contaminated
from spindrift.llm.mixing import mix_sources
from spindrift.llm.queries import tokenizer_path
from spindrift.llm.simhash import simhash_groups
from spindrift.llm.tokens import read_tokens, write_tokens
from spindrift.llm.toxicity import fit_toxicity, score_toxicity

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: The rarest source is taken this often at most; every source, and so every document, at least once.
MAX_REPEATS = 2.0


def _told(docs: DataFrame) -> DataFrame:
    """The columns of documents and a hash that tells rows apart."""
    return docs.select(*COLUMNS, F.xxhash64(*COLUMNS).alias("_row"))


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects (score 0.5 or more) go."""
    bounded_batches(spark)
    model = fit_toxicity(docs, table(spark, sf_dir, "labels"))
    if model.constant is not None:  # labels of one class, or none
        return docs.select(*COLUMNS)
    scored = score_toxicity(docs, model, carry=COLUMNS[1:])
    return scored.filter(F.col("score") < 0.5).select(*COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates one row stays, that with the smallest id."""
    bounded_batches(spark)
    rows = _told(docs)
    groups = simhash_groups(rows, carry=("_row",))
    stay = groups.groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "_row")).alias("m"))
    stay = stay.select(F.col("m._row").alias("_row"), F.col("m.doc_id").alias("_id"))
    kept = rows.join(stay, (rows["_row"] == stay["_row"]) & rows["doc_id"].eqNullSafe(stay["_id"]), "left_semi")
    return kept.dropDuplicates(["_row", "doc_id"]).select(*COLUMNS)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a window that is similar to a benchmark item go."""
    rows = _told(docs)
    found = contaminated(rows, table(spark, sf_dir, "benchmark"), id_col="_row").select("_row").distinct()
    return rows.join(found, "_row", "left_anti").select(*COLUMNS)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its source's weight asks, at least once."""
    return mix_sources(docs, carry=("text", "lang", "n_chars"), max_repeats=MAX_REPEATS).select(*COLUMNS)


def token_output(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files in ascending doc_id order; a row for each document written."""
    bounded_batches(spark)
    return read_tokens(write_tokens(docs, tokenizer_path(), end_id=1))


STAGES = [
    ("toxicity", toxicity),
    ("simhash near-dedup", near_dedup),
    ("benchmark decontamination", decontamination),
    ("mixing", mixing),
    ("token output", token_output),
]

#: SQL cannot express the classifier, the fingerprints' search and the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
