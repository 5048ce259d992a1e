"""A training corpus from ``documents``: five stages, each one operator.

Each stage takes what the stage before it kept and returns whole rows; all but
the last return the columns of its input. ``run`` writes every stage's rows to
the shared folder and reads them for the next one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobreview.llm import decontaminate as decontamination
from jobreview.llm import line_dedup, near_dups, sentencepieces
from jobreview.llm import toxicity as tox
from jobreview.llm.common import fresh, table, written


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored 0.7 or more go. The model is fit on the labels of the
    documents at hand (a bounded sample, held-out rows left out)."""
    model = tox.fit_toxicity(docs, table(spark, sf_dir, "labels"))
    score = fresh(docs, "score")
    scored = tox.score_toxicity(docs, model, docs.columns, score_col=score)
    return scored.filter(F.col(score) < tox.THRESHOLD).select(docs.columns)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated lines go, near-equal ones included; so do documents that held
    nothing else. ``n_chars`` follows the text."""
    removed = fresh(docs, "lines_removed")
    left = line_dedup.dedup_lines(docs)
    left = left.filter((F.col(removed) == 0) | (F.trim("text") != "") | F.col("text").isNull())
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        length = F.when(F.col(removed) > 0, F.length("text").cast(kind)).otherwise(F.col("n_chars"))
        left = left.withColumn("n_chars", length)
    return left.select(docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays: shingles of five words, 0.8."""
    return near_dups.drop_near_duplicates(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents holding a benchmark item go."""
    return decontamination.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with their piece ids, decoded and compared."""
    return sentencepieces.encode_table(docs, keep=docs.columns)


STAGES = [
    ("toxicity", toxicity),
    ("line_dedup", lines),
    ("near_dedup", near_duplicates),
    ("decontaminate", decontaminate),
    ("sentencepiece", pieces),
]

# The learned model and the piece segmentation are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"corpus-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
