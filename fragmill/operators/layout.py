"""Byte layout: running offsets, contiguity, overlap, coverage, tier rollups, strict span checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

ITEM_SIZES = {"BOOL": 1, "U8": 1, "I8": 1, "F8_E4M3": 1, "F8_E5M2": 1, "I16": 2, "U16": 2, "F16": 2, "BF16": 2, "I32": 4, "U32": 4, "F32": 4, "I64": 8, "U64": 8, "F64": 8}  # fixed values


def running_offsets(df: DataFrame, by: list[str], order: list[str | Column], size: str = "size") -> DataFrame:
    """lo and hi of each row's half-open span when rows are laid out in order."""
    w = W.partitionBy(*by).orderBy(*order).rowsBetween(W.unboundedPreceding, W.currentRow)
    hi = F.sum(size).over(w)
    return df.withColumn("hi", hi).withColumn("lo", F.col("hi") - F.col(size))


def contiguity_violations(spans: DataFrame, by: list[str], first: int | None = None) -> DataFrame:
    """Spans that don't begin where the one before ends; ``expected`` is where they should."""
    prev = F.lag("hi").over(W.partitionBy(*by).orderBy("lo", "hi"))
    expected = F.coalesce(prev, F.lit(first).cast("long")) if first is not None else prev
    return spans.withColumn("expected", expected).where("expected is not null and lo <> expected")


def overlap_violations(spans: DataFrame, by: list[str]) -> DataFrame:
    """Spans that begin before the one before them ends."""
    return spans.withColumn("previous_hi", F.lag("hi").over(W.partitionBy(*by).orderBy("lo", "hi"))).where("lo < previous_hi")


def expert_spans(tensors: DataFrame, by: list[str]) -> DataFrame:
    """[lo, hi) of each group of tensors, and whether the group fills it without gap or overlap."""
    w = W.partitionBy(*by).orderBy("lo", "hi")
    steps = tensors.withColumn("gap", F.col("lo") - F.lag("hi").over(w))
    return steps.groupBy(*by).agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), (F.coalesce(F.max(F.abs("gap")), F.lit(0)) == 0).alias("contiguous"))


def coverage(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """Extrema, number and holes of the integers present."""
    g = df.groupBy(*by).agg(F.min(value).alias("lo"), F.max(value).alias("hi"), F.sort_array(F.collect_set(value)).alias("present"))
    return g.withColumn("holes", F.array_except(F.sequence("lo", "hi"), "present"))


def tier_rollup(segments: DataFrame) -> DataFrame:
    """Per tier: layers covered and their extrema and holes, number of segments, most experts, sources."""
    g = segments.groupBy("k").agg(
        F.countDistinct("layer").alias("layers"),
        F.min("layer").alias("layer_lo"),
        F.max("layer").alias("layer_hi"),
        F.count("*").alias("segments"),
        F.max("experts").alias("max_experts"),
        F.countDistinct("source").alias("sources"),
    )
    return g.withColumn("holes", F.col("layer_hi") - F.col("layer_lo") + 1 - F.col("layers"))


def count_by_tier(df: DataFrame) -> DataFrame:
    return df.groupBy("layer", "k").agg(F.count("*").alias("experts"))


def max_layer_experts(df: DataFrame) -> DataFrame:
    """The largest number of experts that any layer has over all tiers."""
    return df.groupBy("layer").agg(F.sum("experts").alias("n")).agg(F.max("n").alias("max_experts"))


def span_violations(tensors: DataFrame) -> DataFrame:
    """Strict checks of tensors(path, name, dtype, shape, lo, hi, body_size): the first rule that fails."""
    size = F.element_at(F.create_map(*(F.lit(x) for kv in ITEM_SIZES.items() for x in kv)), F.col("dtype"))
    count = F.aggregate("shape", F.lit(1).cast("long"), lambda a, x: a * x)
    prev = F.lag("hi").over(W.partitionBy("path").orderBy("lo", "hi", "name"))
    rule = (
        F.when(size.isNull(), "unknown dtype")
        .when(F.col("shape").isNull() | F.exists("shape", lambda x: F.coalesce(x < 0, F.lit(True))), "bad shape")
        .when(~F.coalesce((F.col("lo") >= 0) & (F.col("hi") >= F.col("lo")) & (F.col("hi") <= F.col("body_size")), F.lit(False)), "span outside body")
        .when(F.col("hi") - F.col("lo") != size * count, "span size")
        .when(prev > F.col("lo"), "overlap")
    )
    return tensors.withColumn("rule", rule).where("rule is not null")
