"""The registered queries opN_<name> of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from fragmill.llm._tables import bounded


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return bounded(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from fragmill.llm.substring import remove_repeated_windows

    return remove_repeated_windows(table(spark, sf_dir, "documents"), 35)


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from fragmill.llm.suffix import remove_repeated_bytes

    return remove_repeated_bytes(table(spark, sf_dir, "documents"), 400)


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from fragmill.llm.quality import score_quality

    return score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from fragmill.llm.minhash import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from fragmill.llm.packing import pack

    return pack(table(spark, sf_dir, "documents"))


def op6_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    from fragmill.llm.fingerprint import fingerprints

    return fingerprints(table(spark, sf_dir, "documents"))


def op7_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    from fragmill.llm.suffixtree import score_texts

    return score_texts(table(spark, sf_dir, "documents"), longest=None)


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from fragmill.llm.decontaminate import leaks

    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from fragmill.llm.toxicity import score_toxicity

    return score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from fragmill.llm.pii import find_pii

    return find_pii(table(spark, sf_dir, "documents"))


def llm_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = {k: f for k, f in globals().items() if k.startswith("op") and callable(f)}
    return dict(sorted(found.items(), key=lambda x: int(x[0][2:].split("_")[0])))


def llm_oracle_sql() -> dict[str, str]:
    from fragmill.llm.sql import OP1, OP2, OP4

    return {"op1_substring_dedup": OP1, "op2_suffix_dedup": OP2, "op4_near_dedup": OP4}
