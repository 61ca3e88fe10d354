"""A training corpus from `documents`: toxic and poor documents go, one of each group of near copies stays,
secrets are masked, and what is left is packed into sequences.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read again as the
next stage's documents. All stages but the last return the columns they were given. Empty tables give empty
results; rows with null ids or texts are handled as the operators' docstrings say.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from rulegate.llm import near_copies, packing, quality_rules, secret_scan, toxicity
from rulegate.llm.common import held_out, table
from rulegate.llm.queries import vocabulary_path
from rulegate.session import materialize

MASK = "[SECRET]"


def _row(docs: DataFrame):
    """The whole row as one column, so that none of its columns can clash with an operator's."""
    return F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")


def _rows(docs: DataFrame) -> DataFrame:
    return docs.select(_row(docs), "doc_id", "text")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels")
    model = toxicity.fit(docs, labels.where(~held_out(F.col("doc_id"), 5, 0)))
    if not model[0]:  # without a weight all documents score alike: nothing tells a toxic one, so all stay
        return docs
    scored = toxicity.score(docs.select(_row(docs)), model, text_col="row.text", keep=["row"])
    return scored.where("predicted = 0").select("row.*")


def drop_poor(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    judged = quality_rules.judge(quality_rules.ledger(quality_rules.measure(_rows(docs), keep=["row"])))
    return judged.where("kept").select("row.*")


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of texts with a five-word Jaccard similarity of 0.8 or more. The SimHash index proposes
    what it reaches and MinHash bands the rest, both are checked: see `near_copies`."""
    return near_copies.one_of_each(docs)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = secret_scan.scan(_rows(docs), secret_scan.MASK_RULES)
    masked = found.withColumn("text", secret_scan.redact(F.col("text"), F.col("secrets"), MASK))
    out = {c: F.col(f"row.`{c}`") for c in docs.columns} | {"text": F.col("text")}
    if "n_chars" in out:
        out["n_chars"] = F.when(F.size("secrets") == 0, out["n_chars"]).otherwise(F.length("text"))
    return masked.select(*[out[c].cast(docs.schema[c].dataType).alias(c) for c in docs.columns])


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack_documents(docs, vocabulary_path())


STAGES = [
    ("toxicity", drop_toxic),
    ("quality rules", drop_poor),
    ("SimHash near-dedup", drop_copies),
    ("secret scans", mask_secrets),
    ("best-fit packing", pack),
]

# Fitted weights and bit arithmetic over fingerprints are not SQL; tests/llm checks the stages against plain Python
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`."""
    docs = table(spark, sf_dir, "documents")
    for number, (_, stage) in enumerate(STAGES):
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{number}")
    return docs
