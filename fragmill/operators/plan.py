"""Fetch planning: provider choice, completeness, request coalescing, cost.

Coalescing with a size cap walks the pieces of one (source, file) in offset order; files are many.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def choose(candidates: DataFrame, key: list[str], order: list[Column | str]) -> DataFrame:
    """The first candidate of each key (planned as a group limit: partial choice before the shuffle)."""
    return candidates.withColumn("_rank", F.row_number().over(W.partitionBy(*key).orderBy(*order))).where("_rank = 1").drop("_rank")


def fetch_plan(policy: DataFrame, spans: DataFrame, prefer: DataFrame | None = None) -> DataFrame:
    """policy(fragment, k) joined to spans(source, source_order, file, fragment, k, lo, hi, sha256): one
    provider per fragment, preferred digests first, then the source's order; local offsets per file."""
    found = policy.join(spans, ["fragment", "k"])
    if prefer is not None:
        hit = prefer.select("fragment", F.col("sha256").alias("wanted"))
        found = found.join(hit, "fragment", "left").withColumn("preferred", F.coalesce(F.col("sha256") == F.col("wanted"), F.lit(False))).drop("wanted")
    else:
        found = found.withColumn("preferred", F.lit(False))
    chosen = choose(found, ["fragment", "k"], [F.desc("preferred"), "source_order", "lo"])
    w = W.partitionBy("source", "file").orderBy("lo").rowsBetween(W.unboundedPreceding, W.currentRow)
    return chosen.withColumn("size", F.col("hi") - F.col("lo")).withColumn("local_off", F.sum("size").over(w) - F.col("size"))


def unsatisfied(prefer: DataFrame, plan: DataFrame) -> DataFrame:
    """Preferred digests that no chosen fragment has."""
    return prefer.join(plan.select("fragment", "sha256"), ["fragment", "sha256"], "left_anti")


def override_provider(cells: DataFrame, layers: DataFrame, experts: DataFrame, default: str) -> DataFrame:
    """Provider of each (layer, expert): the expert's override, else the layer's, else the default."""
    out = cells.join(experts.withColumnRenamed("provider", "pe"), ["layer", "expert"], "left").join(layers.withColumnRenamed("provider", "pl"), "layer", "left")
    return out.withColumn("provider", F.coalesce("pe", "pl", F.lit(default))).drop("pe", "pl")


def matches_alias(alias: Column, *spellings: Column) -> Column:
    """Whether an alias names a source in any of its spellings."""
    return F.coalesce(F.array_contains(F.array(*spellings), alias), F.lit(False))


def completeness_violations(wanted: DataFrame, plan: DataFrame, key: list[str]) -> DataFrame:
    """Requested tuples without exactly one piece, and pieces that nobody requested."""
    a = wanted.groupBy(*key).agg(F.count("*").alias("asked"))
    b = plan.groupBy(*key).agg(F.count("*").alias("planned"))
    both = a.join(b, key, "full").fillna(0, ["asked", "planned"])
    rule = F.when(F.col("asked") == 0, "unrequested").when(F.col("planned") == 0, "missing").when(F.col("planned") > 1, "duplicate")
    return both.withColumn("rule", rule).where("rule is not null")


def coalesce_by_gap(pieces: DataFrame, by: list[str], gap: int) -> DataFrame:
    """Requests without a size cap: gaps and islands."""
    w = W.partitionBy(*by).orderBy("lo", "hi")
    new = (F.col("lo") - F.lag("hi").over(w) <= gap) & (F.col("lo") >= F.lag("hi").over(w))
    marked = pieces.withColumn("island", F.sum(F.when(new, 0).otherwise(1)).over(w.rowsBetween(W.unboundedPreceding, W.currentRow)))
    out = marked.groupBy(*by, "island").agg(F.min("lo").alias("start"), F.max("hi").alias("stop"), F.count("*").alias("n_pieces"), F.sum(F.col("hi") - F.col("lo")).alias("useful"))
    return out.drop("island").withColumn("wasted", F.col("stop") - F.col("start") - F.col("useful"))


def coalesce_capped(pieces: DataFrame, by: list[str], gap: int, cap: int) -> DataFrame:
    """Greedy requests: a piece joins the open request if the gap is in [0, gap] and the request stays
    within cap. The pieces of one file are a chain, so one task walks them, in offset order, as a stream of sorted
    batches with one open request in memory."""
    keys = pieces.select(*by).schema

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        names = [*by, "start", "stop", "n_pieces", "useful", "wasted"]
        request = None

        def closed(r):
            return (*r[0], r[1], r[2], r[3], r[4], r[2] - r[1] - r[4])

        for batch in batches:
            done = []
            for *key, lo, hi in zip(*(batch.column(c).to_pylist() for c in by), batch.column("lo").to_pylist(), batch.column("hi").to_pylist()):
                if request is not None and request[0] == key and 0 <= lo - request[2] <= gap and hi - request[1] <= cap:
                    request[2], request[3], request[4] = hi, request[3] + 1, request[4] + hi - lo
                else:
                    if request is not None:
                        done.append(closed(request))
                    request = [key, lo, hi, 1, hi - lo]
            if done:
                yield pa.RecordBatch.from_pylist([dict(zip(names, r)) for r in done])
        if request is not None:
            yield pa.RecordBatch.from_pylist([dict(zip(names, closed(request)))])

    rows = pieces.select(*by, F.col("lo").cast("long").alias("lo"), F.col("hi").cast("long").alias("hi"))
    out = keys
    for c in ("start", "stop", "n_pieces", "useful", "wasted"):
        out = out.add(c, "long")
    return rows.repartition(*by).sortWithinPartitions(*by, "lo", "hi").mapInArrow(run, out)


def coalesce_adjacent(pieces: DataFrame, by: list[str], cap: int) -> DataFrame:
    """Only touching pieces share a request; overlapping pieces raise."""
    prev = F.lag("hi").over(W.partitionBy(*by).orderBy("lo", "hi"))
    checked = pieces.withColumn("lo", F.when(prev > F.col("lo"), F.raise_error(F.lit("pieces overlap"))).otherwise(F.col("lo")).cast("long"))
    return coalesce_capped(checked, by, 0, cap)


def counterfactual(plan: DataFrame, files: DataFrame) -> DataFrame:
    """Bytes at three grains: the ranges, the files they touch (each once), and all files of the chosen tiers."""
    ranged = plan.agg(F.coalesce(F.sum(F.col("hi") - F.col("lo")), F.lit(0)).alias("ranged"))
    touched = files.join(plan.select("source", "file").distinct(), ["source", "file"], "left_semi").agg(F.coalesce(F.sum("size"), F.lit(0)).alias("touched"))
    tiers = files.join(plan.select("source", "k").distinct(), ["source", "k"], "left_semi").agg(F.coalesce(F.sum("size"), F.lit(0)).alias("tiers"))
    return ranged.select("ranged", touched.scalar().alias("touched"), tiers.scalar().alias("tiers"))


def bytes_needed(plan: DataFrame) -> DataFrame:
    return plan.groupBy("source", "file").agg(F.sum(F.col("hi") - F.col("lo")).alias("bytes"))


def authentication_cost(files: DataFrame) -> DataFrame:
    """Per method of proving a header: how many files, and how many bytes beyond the planned ones."""
    return files.groupBy("method").agg(F.count("*").alias("files"), F.sum(F.when(F.col("method") == "full", F.col("size") - F.col("planned")).otherwise(0)).alias("extra_bytes"))


def transport_totals(requests: DataFrame) -> DataFrame:
    return requests.groupBy("source").agg(F.count("*").alias("requests"), F.sum(F.col("stop") - F.col("start")).alias("bytes"), F.sum("wasted").alias("wasted"))


def plan_digest(plan: DataFrame, by: list[str]) -> DataFrame:
    """Identity of a plan: digest over its pieces in offset order."""
    piece = F.struct("local_off", "fragment", "source", "lo", "hi", "sha256")
    return plan.groupBy(*by).agg(F.sha2(F.to_json(F.array_sort(F.collect_list(piece))), 256).alias("digest"))


def plan_drift(draft: DataFrame, proven: DataFrame) -> DataFrame:
    """Rows by which a draft plan and the plan derived from proven headers differ; empty if they agree."""
    a = draft.exceptAll(proven).withColumn("side", F.lit("draft"))
    return a.unionByName(proven.exceptAll(draft).withColumn("side", F.lit("proven")))


def template_conflicts(headers: DataFrame) -> DataFrame:
    """(layer, k) whose providers disagree on the tensor template."""
    return headers.groupBy("layer", "k").agg(F.countDistinct("template").alias("templates"), F.count_if(F.col("template").isNull()).alias("missing")).where("templates <> 1 or missing > 0")
