"""Keyed resume state: lookups, upserts, migration, provenance drift, resumability."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from fragmill.operators.release import same

KEY = ["source_fp", "k", "layer"]


def pending(work: DataFrame, state: DataFrame, key: list[str] = KEY) -> DataFrame:
    """Work that the state doesn't hold."""
    return work.join(state.select(*key), key, "left_anti")


def upsert(state: DataFrame, new: DataFrame, key: list[str], order: str = "written_at") -> DataFrame:
    """The latest row of each key; a later row evicts rows of the key under other sources."""
    rank = F.row_number().over(W.partitionBy(*key).orderBy(F.desc(order), F.desc("new"), "source_fp"))
    both = state.withColumn("new", F.lit(0)).unionByName(new.withColumn("new", F.lit(1)))
    return both.withColumn("rank", rank).where("rank = 1").drop("rank", "new")


def migrate(v1: DataFrame, source_fp: str) -> DataFrame:
    """State rows keyed by file name, as rows keyed by source, tier and layer; other names are left out."""
    name = r"^layer-(\d+)\.k(\d+)\.safetensors$"
    rows = v1.where(F.col("file").rlike(name))
    return rows.select(F.lit(source_fp).alias("source_fp"), F.regexp_extract("file", name, 2).cast("int").alias("k"), F.regexp_extract("file", name, 1).cast("int").alias("layer"), *v1.columns)


def drift(state: DataFrame, now: DataFrame, by: list[str]) -> DataFrame:
    """What becomes of each stored row: keep, record (another producer) or discard (another source)."""
    n = now.select(*by, F.col("source").alias("now_source"), F.col("producer").alias("now_producer"))
    what = F.when(~same(F.col("source"), F.col("now_source")), "discard").when(~same(F.col("producer"), F.col("now_producer")), "record").otherwise("keep")
    return state.join(n, by, "left").withColumn("action", what).drop("now_source", "now_producer")


def resumable(row: dict[str, Column]) -> Column:
    """Why a stored output can't be used again; NULL if it can. Tests go in order, the first that fails counts.
    Columns: entry_sha, entry_size, file_sha, file_size, source, want_source, layout, want_layout, signed."""
    return (
        F.when(row["entry_sha"].isNull(), "no entry")
        .when(~same(row["source"], row["want_source"]), "other source")
        .when(~same(row["layout"], row["want_layout"]), "other layout")
        .when(row["file_size"].isNull(), "no file")
        .when(~same(row["entry_size"], row["file_size"]), "size")
        .when(~same(row["entry_sha"], row["file_sha"]), "digest")
        .when(~F.coalesce(row["signed"], F.lit(False)), "not signed")
    )


def family_violations(existing: DataFrame, base_model: str, layout: str) -> DataFrame:
    """Rows of an output family that another model or layout has written."""
    return existing.where(~(same(F.col("base_model"), F.lit(base_model)) & same(F.col("layout"), F.lit(layout))))


def digest_cache(files: DataFrame, cache: DataFrame) -> DataFrame:
    """Files whose size and times match a cached digest get it; the others have NULL and must be hashed."""
    key = ["path", "size", "mtime"]
    return files.join(cache.select(*key, "sha256"), key, "left")


def content_first(fragments: DataFrame, digest: str, order: list) -> DataFrame:
    """One provider for each content, the first in order."""
    return fragments.withColumn("rank", F.row_number().over(W.partitionBy(digest).orderBy(*order))).where("rank = 1").drop("rank")


def index_for(rows: DataFrame, k: int) -> DataFrame:
    """Index of one tier, rebuilt from its rows alone; a row without digest or span is an error."""
    bad = F.col("sha256").isNull() | F.col("lo").isNull() | F.col("hi").isNull()
    rows = rows.where(F.col("k") == k).withColumn("lo", F.when(bad, F.raise_error(F.lit("corrupt row"))).otherwise(F.col("lo")).cast("long"))
    return rows.groupBy("layer").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("expert", F.array("lo", "hi"))))).alias("experts"), F.first("sha256").alias("sha256"))


def merge_manifest(existing: DataFrame, rebuilt: DataFrame) -> DataFrame:
    """Rows per tier: the rebuilt ones, and existing ones of tiers that weren't rebuilt."""
    return rebuilt.unionByName(existing.join(rebuilt.select("k"), "k", "left_anti"))


def load_state(text: str | None, schema: str, strict: bool) -> dict:
    """A resume state from its JSON text: nothing or unreadable text is a fresh state, unless strict; another schema is an
    error when strict, else a fresh state."""
    try:
        state = json.loads(text) if text else {"schema": schema, "files": {}}
    except ValueError:
        state = None
    if isinstance(state, dict) and state.get("schema") == schema:
        return state
    if strict:
        raise ValueError("a state of another schema, or unreadable")
    return {"schema": schema, "files": {}}
