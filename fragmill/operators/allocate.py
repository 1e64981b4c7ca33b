"""Numeric analysis of precision tiers: benefit of an upgrade, concentration, budgets.

Tables are long: eps(k, layer, expert, eps, phi) with phi the number of tokens routed to an expert. NULL eps
or phi count as missing cells, which ``dense_violations`` reports.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


MOST_SORTED, PARTS = 100_000, 256


def dense_violations(eps: DataFrame, experts: int) -> DataFrame:
    """(k, layer) whose experts aren't exactly 0 .. experts - 1, or whose cells lack a value."""
    g = eps.groupBy("k", "layer").agg(F.count("*").alias("cells"), F.countDistinct("expert").alias("ids"), F.min("expert").alias("lo"), F.max("expert").alias("hi"), F.count_if(F.col("eps").isNull() | F.col("phi").isNull()).alias("nulls"))
    return g.where(~((F.col("cells") == experts) & (F.col("ids") == experts) & (F.col("lo") == 0) & (F.col("hi") == experts - 1) & (F.col("nulls") == 0)))


def common_layers(eps: DataFrame) -> DataFrame:
    """Layers that every tier has."""
    n = eps.select("k").distinct().count()
    return eps.groupBy("layer").agg(F.countDistinct("k").alias("tiers")).where(F.col("tiers") == n).select("layer")


def mean_error(eps: DataFrame) -> DataFrame:
    return eps.groupBy("k").agg(F.avg("eps").alias("mean_eps"))


def benefit(eps: DataFrame, lo: int, hi: int) -> DataFrame:
    """layer, expert, delta (error gap), share (of the layer's routing mass) and their product."""
    pivot = eps.where(F.col("k").isin(lo, hi)).groupBy("layer", "expert").agg(
        F.max(F.when(F.col("k") == lo, F.col("eps"))).alias("e_lo"), F.max(F.when(F.col("k") == hi, F.col("eps"))).alias("e_hi"), F.max(F.when(F.col("k") == lo, F.col("phi"))).alias("phi")
    )
    pivot = pivot.where("e_lo is not null and e_hi is not null")
    mass = F.greatest(F.sum("phi").over(W.partitionBy("layer")), F.lit(1))
    return pivot.select("layer", "expert", (F.col("e_lo") - F.col("e_hi")).alias("delta"), (F.col("phi") / mass).alias("share")).withColumn("benefit", F.col("delta") * F.col("share"))


def variation(cells: DataFrame) -> DataFrame:
    """Per layer: mean of delta and its coefficient of variation (population deviation)."""
    return cells.groupBy("layer").agg(F.avg("delta").alias("delta_mean"), (F.stddev_pop("delta") / F.greatest(F.abs(F.avg("delta")), F.lit(1e-12))).alias("delta_cv"))


def gini(cells: DataFrame, by: str = "layer", value: str = "benefit", tie: str = "expert") -> DataFrame:
    """Gini coefficient of the non-negative part of value per group; 0 where the total is 0."""
    x = F.greatest(F.col(value), F.lit(0.0))
    order = W.partitionBy(by).orderBy("x", tie)
    rows = cells.select(by, tie, x.alias("x")).withColumn("cum", F.sum("x").over(order.rowsBetween(W.unboundedPreceding, 0)))
    total, n = F.sum("x"), F.count("*")
    return rows.groupBy(by).agg(F.when(total == 0, F.lit(0.0)).otherwise((n + 1 - 2 * (F.sum("cum") / total)) / n).alias("gini"))


def top_share(cells: DataFrame, top: int = 16) -> DataFrame:
    """Per layer the share of the summed benefit that the ``top`` experts hold."""
    rank = F.row_number().over(W.partitionBy("layer").orderBy(F.desc("benefit"), "expert"))
    ranked = cells.withColumn("rank", rank)
    return ranked.groupBy("layer").agg((F.sum(F.when(F.col("rank") <= top, F.col("benefit")).otherwise(0.0)) / F.greatest(F.sum("benefit"), F.lit(1e-18))).alias("top_share"))


def abort_verdict(cells: DataFrame, cv: float = 0.1, concentration: float = 0.2) -> DataFrame:
    """One row: medians over layers, and whether sensitivity is too even for an allocation to pay."""
    both = variation(cells).join(gini(cells), "layer")
    out = both.agg(F.median("delta_cv").alias("median_cv"), F.median("gini").alias("median_gini"))
    return out.withColumn("fires", (F.col("median_cv") < cv) & (F.col("median_gini") < concentration))


def budget_of(fraction: float, cells: int) -> int:
    """Half-even rounding of the share of cells."""
    return int(round(fraction * cells))


def budget_solve(cells: DataFrame, budget: int) -> DataFrame:
    """Cells that a global budget upgrades: the largest benefits, ties by (layer, expert). A budget up to MOST_SORTED
    is a top-k; beyond, cells are counted between PARTS quantiles of the benefit, whole ranges are taken by a filter,
    and only the range that the budget cuts is ranked."""
    order = [F.desc("benefit"), F.col("layer"), F.col("expert")]
    if budget <= MOST_SORTED:
        return cells.orderBy(*order).limit(max(budget, 0))
    marks = cells.agg(F.percentile_approx("benefit", [i / PARTS for i in range(1, PARTS)], 100 * PARTS)).first()[0] or []
    marks = sorted(set(marks))
    above = F.size(F.filter(F.array(*map(F.lit, marks)), lambda x: x > F.col("benefit"))) if marks else F.lit(0)
    ranged = cells.withColumn("_range", F.when(F.col("benefit").isNull(), len(marks) + 1).otherwise(above))
    held = {r["_range"]: r["count"] for r in ranged.groupBy("_range").count().collect()}  # PARTS + 1 rows at most
    taken, cut = 0, 0
    while cut <= len(marks) + 1 and taken + held.get(cut, 0) <= budget:
        taken, cut = taken + held.get(cut, 0), cut + 1
    edge = ranged.where(F.col("_range") == cut).withColumn("_rank", F.row_number().over(W.partitionBy("_range").orderBy(*order)))
    return ranged.where(F.col("_range") < cut).drop("_range").union(edge.where(F.col("_rank") <= budget - taken).drop("_range", "_rank"))


def upgrades_per_layer(cells: DataFrame, budget: int) -> DataFrame:
    picked = budget_solve(cells, budget).groupBy("layer").agg(F.count("*").alias("n_upper"), F.sum("benefit").alias("captured"))
    return cells.select("layer").distinct().join(picked, "layer", "left").fillna({"n_upper": 0, "captured": 0.0})


def uniform_take(layer_place: Column, budget: int, layers: int, experts: int) -> Column:
    """Even quota: the first budget % layers layers get one more; at most all experts."""
    return F.least(F.lit(budget // layers) + F.when(layer_place < budget % layers, 1).otherwise(0), F.lit(experts))


def uniform_baseline(cells: DataFrame, budget: int, layers: int, experts: int) -> DataFrame:
    """Per layer what the same budget captures when it is spread evenly."""
    place = cells.select("layer").distinct().withColumn("place", F.row_number().over(W.orderBy("layer")) - 1)  # a row per layer
    ranked = cells.join(place, "layer").withColumn("rank", F.row_number().over(W.partitionBy("layer").orderBy(F.desc("benefit"), "expert")))
    taken = F.col("rank") <= uniform_take(F.col("place"), budget, layers, experts)
    return ranked.groupBy("layer").agg(F.count_if(taken).alias("n_upper"), F.sum(F.when(taken, F.col("benefit")).otherwise(0.0)).alias("captured"))


def concentration_curve(cells: DataFrame) -> DataFrame:
    """For each rank: median, least and largest cumulative share of the benefit over the layers."""
    order = W.partitionBy("layer").orderBy(F.desc("benefit"), "expert")
    total = F.sum("benefit").over(W.partitionBy("layer"))
    share = F.sum("benefit").over(order.rowsBetween(W.unboundedPreceding, 0)) / total
    ranked = cells.select(F.row_number().over(order).alias("rank"), share.alias("share"))
    return ranked.groupBy("rank").agg(F.median("share").alias("mid"), F.min("share").alias("low"), F.max("share").alias("high"))


def error_ladder(means: DataFrame) -> DataFrame:
    """Ratio of each tier's mean error to the next tier's, and their geometric midpoint; a row per tier."""
    following = F.lead("mean_eps").over(W.orderBy("k"))
    return means.select("k", "mean_eps", (F.col("mean_eps") / following).alias("ratio"), F.sqrt(F.col("mean_eps") * following).alias("midpoint"))


def analysis(eps: DataFrame, pairs: list[tuple[int, int]], fractions: list[float], layers: int, experts: int) -> DataFrame:
    """All figures of an error table as rows (part, layer, name, value): mean error of each tier, for each pair of
    tiers the variation, concentration and verdict, and for each budget what the solution captures beside the even
    baseline (advantage in percent). The parts are the operators of this module."""
    none = F.lit(None).cast("long")

    def rows(df: DataFrame, part: str, layer: Column, **values: Column) -> DataFrame:
        pair = [F.struct(F.lit(n).alias("name"), v.cast("double").alias("value")) for n, v in values.items()]
        return df.select(F.lit(part).alias("part"), layer.cast("long").alias("layer"), F.explode(F.array(*pair)).alias("x")).select("part", "layer", "x.name", "x.value")

    out = mean_error(eps).select(F.lit("means").alias("part"), none.alias("layer"), F.concat(F.lit("k"), F.col("k").cast("string")).alias("name"), F.col("mean_eps").alias("value"))
    for lo, hi in pairs:
        cells = benefit(eps, lo, hi)
        part = f"k{lo} to k{hi}"
        both = variation(cells).join(gini(cells), "layer").join(top_share(cells), "layer")
        out = out.union(rows(both, part, F.col("layer"), delta_cv=F.col("delta_cv"), gini=F.col("gini"), top_share=F.col("top_share")))
        out = out.union(rows(abort_verdict(cells), part, none, median_cv=F.col("median_cv"), median_gini=F.col("median_gini"), fires=F.col("fires").cast("int")))
    cells = benefit(eps, *pairs[0])
    for f in fractions:
        b = budget_of(f, layers * experts)
        solved = upgrades_per_layer(cells, b).agg(F.sum("captured").alias("captured"), F.min("n_upper").alias("least"), F.max("n_upper").alias("most"))
        even = uniform_baseline(cells, b, layers, experts).agg(F.sum("captured").alias("even"))
        gain = 100 * (F.col("captured") / F.greatest(F.col("even"), F.lit(1e-18)) - 1)
        one = solved.select("*", even.scalar().alias("even"))
        out = out.union(rows(one, f"budget {f}", none, captured=F.col("captured"), even=F.col("even"), advantage=gain, least=F.col("least"), most=F.col("most")))
    return out


def allocation(cells: DataFrame, fraction: float, layers: int, experts: int) -> DataFrame:
    """Per layer the upgraded experts of the global solution beside the uniform line."""
    b = budget_of(fraction, layers * experts)
    return upgrades_per_layer(cells, b).select("layer", "n_upper", F.lit(b / layers).alias("uniform"))
