"""Priming: one layer of a source as segments by tier and a shared profile, with what may be said of them.

The layer's header rows say what there is; ``segment_layout`` gives every file's tensors their places,
``source_ranges`` what to read, and ``prime_layer`` runs both phases: the profile first, as its digest goes into
the segments' metadata, then all tiers in one sweep over the source.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from fragmill.operators.checks import SourceLayoutError, assert_clean, layer_analysis, topology_violations
from fragmill.operators.fetch import TENSOR_ORDER, header_json, land
from fragmill.operators.plan import coalesce_adjacent

RANKS = 4


def preflight(tensors: DataFrame, config: DataFrame, layout: str | None, targets: DataFrame) -> DataFrame:
    """Rules that a source breaks before any payload is read. Only the layout rank_sliced_tp4 is judged: a stated tp
    must be the integer 4, and each target (layer, expert; NULL: all experts) must have the topology of RANKS ranks.
    Layers without routed experts aren't judged. config: one row with tp as a JSON value or NULL."""
    none = F.lit(None)
    if layout != "rank_sliced_tp4":
        return tensors.sparkSession.createDataFrame([], "layer int, expert int, rule string")
    stated = config.where("tp is not null and not (tp rlike '^4\\\\z')").select(none.cast("int").alias("layer"), none.cast("int").alias("expert"), F.lit("tp").alias("rule"))
    routed = tensors.join(targets.select("layer").distinct(), "layer", "left_semi")
    whole = targets.where("expert is null").select("layer")
    some = targets.where("expert is not null").select("layer", "expert").distinct()
    judged = routed.join(whole, "layer", "left_semi").unionByName(routed.join(whole, "layer", "left_anti").join(some, ["layer", "expert"], "left_semi"))
    broken = topology_violations(judged, RANKS).groupBy("layer", "expert").agg(F.min("rule").alias("rule"))
    absent = some.join(routed.select("layer").distinct(), "layer", "left_semi").join(routed.select("layer", "expert").distinct(), ["layer", "expert"], "left_anti")
    out = broken.select("layer", "expert", "rule").union(absent.select("layer", "expert", F.lit("no such expert")))
    return stated.union(out.select(F.col("layer").cast("int"), F.col("expert").cast("int"), "rule"))


def segment_metadata(source: dict[str, Column], layer: Column, layout: Column, experts: Column, predicate: str = "repack-of", **extra: Column) -> Column:
    """Metadata of a segment as a map of texts; fields that are NULL are left out. source: repo, revision, file,
    base_model and file_sha256."""
    fields = {"predicate": F.lit(predicate), "layer": layer, "layout": layout, "num_experts": experts, "source_file": source["file"], "source_repo": source["repo"], "source_revision": source["revision"], "base_model": source["base_model"], "source_file_sha256": source["file_sha256"], **extra}
    every = F.create_map(*(x for k, v in fields.items() for x in (F.lit(k), v.cast("string"))))
    return F.map_filter(every, lambda k, v: v.isNotNull())


def statement(source: dict[str, Column], layout: Column, file: Column, sha256: Column, size: Column, config: Column, corpus: Column, created: Column, predicate: str = "repack-of") -> Column:
    """What may be said of a file that was made from a source, as a struct to be signed."""
    fragment = F.struct(file.alias("file"), sha256.alias("sha256"), size.alias("size"))
    materials = F.struct(source["repo"].alias("repo"), source["revision"].alias("revision"), source["file"].alias("file"), source["file_sha256"].alias("file_sha256"))
    fields = {"predicate": F.lit(predicate), "fragment": fragment, "materials": materials, "layout": layout, "base_model": source["base_model"], "calibration_corpus_sha256": corpus, "source_config": config, "created_utc": created}
    return F.struct(*(v.alias(k) for k, v in fields.items()))


def segment_layout(tensors: DataFrame, tiers: list[int]) -> DataFrame:
    """Tensors of the experts of the given tiers with their places in the segment of (layer, k): experts in order,
    tensors in canonical order. The source's spans stay as lo, hi."""
    rows = tensors.where(F.col("k").isin(tiers)).withColumn("size", F.col("hi") - F.col("lo"))
    w = W.partitionBy("layer", "k").orderBy(*TENSOR_ORDER).rowsBetween(W.unboundedPreceding, W.currentRow)
    return rows.withColumn("new_hi", F.sum("size").over(w)).withColumn("new_lo", F.col("new_hi") - F.col("size"))


def profile_layout(shared: DataFrame) -> DataFrame:
    """The layer's shared tensors with their places in its profile."""
    rows = shared.withColumn("size", F.col("hi") - F.col("lo"))
    w = W.partitionBy("layer").orderBy("proj_ord", "rank", "comp_ord", "name").rowsBetween(W.unboundedPreceding, W.currentRow)
    return rows.withColumn("new_hi", F.sum("size").over(w)).withColumn("new_lo", F.col("new_hi") - F.col("size"))


def source_ranges(laid: DataFrame, cap: int) -> DataFrame:
    """Requests of a sweep over each source file: only touching tensors share one, up to cap bytes."""
    return coalesce_adjacent(laid.select("path", "lo", "hi"), ["path"], cap)


def need(tensors: DataFrame, shared: DataFrame, tiers: list[int]) -> DataFrame:
    """Per layer: bytes that priming reads, and experts by tier."""
    size = F.col("hi") - F.col("lo")
    own = tensors.groupBy("layer").agg(F.sum(F.when(F.col("k").isin(tiers), size).otherwise(0)).alias("routed"))
    common = shared.groupBy("layer").agg(F.sum(size).alias("common"))
    counts = tensors.groupBy("layer", "k").agg(F.countDistinct("expert").alias("n")).groupBy("layer").agg(F.to_json(F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.col("k").cast("string").alias("k"), "n"))))).alias("experts"))
    both = own.join(common, "layer", "left").join(counts, "layer")
    return both.select("layer", (F.col("routed") + F.coalesce("common", F.lit(0))).alias("bytes"), "experts")


def _landed(laid: DataFrame, file: Column, metadata: Column, read, folder: str) -> DataFrame:
    rows = laid.withColumn("file", file)
    layouts = header_json(rows).join(rows.groupBy("file").agg(F.first(F.to_json(metadata)).alias("metadata")), "file")
    content = read(rows.select("path", (F.col("body_offset") + F.col("lo")).alias("start"), (F.col("body_offset") + F.col("hi")).alias("stop")))
    pieces = rows.withColumn("start", F.col("body_offset") + F.col("lo")).join(content.select("path", "start", "sha256", "content"), ["path", "start"])
    return land(pieces.select("file", F.col("new_lo").alias("local_off"), "size", "sha256", "content"), layouts, folder)


def prime_layer(tensors: DataFrame, shared: DataFrame, tiers: list[int], source: dict[str, str], read, folder: str) -> dict[str, DataFrame]:
    """Lands the segments (and the shared profile) of the layers in tensors; tables: analysis, profile, segments.
    read(requests): rows (path, start, stop) with sha256 and content, as the source byte_spans gives them. Layers whose
    experts aren't of one tier or that break the topology are refused before anything is read."""
    assert_clean(topology_violations(tensors, RANKS), SourceLayoutError)
    what = layer_analysis(tensors, shared)
    assert_clean(what.where("tiers <> 1 or signatures <> 1"), SourceLayoutError)
    told = {k: F.lit(v) for k, v in source.items()}
    layouts = what.select("layer", "layout")
    experts = tensors.groupBy("layer").agg(F.countDistinct("expert").alias("n_layer"))
    profile = profile_layout(shared).join(layouts, "layer").join(experts, "layer")
    name = F.format_string("layer-%03d.shared.safetensors", F.col("layer").cast("int"))
    meta = segment_metadata(told, F.col("layer"), F.col("layout"), F.col("n_layer"), kind=F.lit("shared_profile"))
    first = _landed(profile, name, meta, read, folder)
    first = first.sparkSession.createDataFrame(first.collect(), first.schema)  # a row per layer, written once
    laid = segment_layout(tensors, tiers).join(layouts, "layer")
    laid = laid.join(laid.groupBy("layer", "k").agg(F.countDistinct("expert").alias("n_tier")), ["layer", "k"])
    laid = laid.withColumn("profile", name).join(first.select(F.col("file").alias("profile"), F.col("sha256").alias("profile_sha256")), "profile", "left")
    meta = segment_metadata(told, F.col("layer"), F.col("layout"), F.col("n_tier"), k=F.col("k"), shared_profile_file=F.when(F.col("profile_sha256").isNotNull(), F.col("profile")), shared_profile_sha256=F.col("profile_sha256"))
    file = F.format_string("layer-%03d.k%d.safetensors", F.col("layer").cast("int"), F.col("k").cast("int"))
    return {"analysis": what, "profile": first, "segments": _landed(laid, file, meta, read, folder)}
