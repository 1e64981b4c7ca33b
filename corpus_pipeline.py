"""A training-corpus pipeline: toxicity, near duplicates, benchmark leaks, personal data, packing.

Each stage takes (spark, docs, sf_dir), where docs is what the stage before has written, and works on all of it.
All but the last return the columns of ``documents``; a stage's decisions are what the next one reads.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fragmill.llm._tables import bounded, dropped, written
from fragmill.llm.decontaminate import without_leaks
from fragmill.llm.minhash import without_near_duplicates
from fragmill.llm.packing import pack
from fragmill.llm.pii import find_pii
from fragmill.llm.queries import table
from fragmill.llm.toxicity import without_toxic

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents predicted toxic go. Each row is judged by its own text."""
    return without_toxic(docs, table(spark, sf_dir, "labels"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document with the smallest doc_id stays, once. Near: five-word sets
    alike to 0.8 or more."""
    bounded(spark)
    return without_near_duplicates(docs, percent=80)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return without_leaks(docs, table(spark, sf_dir, "benchmark"))


def pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is masked; n_chars follows the new text. No document goes; columns other than those of documents do."""
    bounded(spark)
    masked = find_pii(docs, with_text=True, carry=("lang", "source", "n_chars"))
    size = F.when(F.col("masked") == F.col("text"), F.col("n_chars")).otherwise(F.length("masked").cast("long"))
    return masked.withColumn("n_chars", size).withColumn("text", F.col("masked")).select(*COLUMNS)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of at most 2048 tokens."""
    bounded(spark)
    return pack(docs)


STAGES = [
    ("toxicity", toxicity),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("pii", pii),
    ("packing", packing),
]
#: The stages' models and tokens can't be expressed in SQL; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what a stage returns is written and read again."""
    docs = first = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        before, docs = docs, written(stage(spark, docs, sf_dir))
        if before is not first:
            dropped(before)
    return STAGES[-1][1](spark, docs, sf_dir)
