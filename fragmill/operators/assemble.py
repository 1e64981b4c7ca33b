"""Override joins and re-layout: a checkpoint from a source and chosen segments."""

from __future__ import annotations

import json
import os
import shutil

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fragmill.operators.checks import AssemblyError
from fragmill.operators.fetch import header_json, land
from fragmill.operators.layout import running_offsets

SENTINEL = ".fragmill-output"


def override_join(source: DataFrame, policy: DataFrame, segments: DataFrame) -> DataFrame:
    """Tensors of a source; those of experts with a policy come from the segment of that tier, the rest pass
    through. from_segment NULL in ``missing`` rows: the segment lacks the tensor. Offsets are laid out anew."""
    want = source.join(policy, ["layer", "expert"], "left")
    seg = segments.select("layer", "expert", "k", "name", F.col("size").alias("seg_size"), F.col("dtype").alias("seg_dtype"))
    both = want.join(seg, ["layer", "expert", "k", "name"], "left")
    routed = F.col("k").isNotNull()
    out = both.withColumn("origin", F.when(~routed, "source").when(F.col("seg_size").isNull(), "missing").otherwise("segment"))
    out = out.withColumn("new_size", F.when(routed, F.col("seg_size")).otherwise(F.col("hi") - F.col("lo")))
    laid = running_offsets(out.withColumnsRenamed({"lo": "old_lo", "hi": "old_hi"}), ["shard"], ["old_lo", "name"], "new_size")
    return laid.withColumnsRenamed({"lo": "new_lo", "hi": "new_hi"})


def needs_reindex(assembled: DataFrame) -> DataFrame:
    """Per shard: whether any span changes its size, so that the header can't be kept."""
    return assembled.groupBy("shard").agg(F.bool_or(F.col("new_size") != F.col("old_hi") - F.col("old_lo")).alias("reindex"), F.count_if(F.col("origin") == "missing").alias("missing"))


def expand_shared(experts: DataFrame, shared: DataFrame) -> DataFrame:
    """Shared rows of a layer as rows of each of its experts."""
    return experts.select("layer", "expert").distinct().join(shared, "layer")


def with_shared(tensors: DataFrame, shared: DataFrame) -> DataFrame:
    """Slots with the layer's shared value where their own component is absent."""
    s = shared.select("layer", "proj", "rank", "comp", F.col("value").alias("shared_value"))
    return tensors.join(s, ["layer", "proj", "rank", "comp"], "left").withColumn("value", F.coalesce("value", "shared_value")).drop("shared_value")


def tier_map(policy: DataFrame) -> DataFrame:
    """Per layer the dense array of tiers in expert order."""
    return policy.groupBy("layer").agg(F.transform(F.array_sort(F.collect_list(F.struct("expert", "k"))), lambda x: x.k).alias("bits"))


def shard_index(tensors: DataFrame) -> DataFrame:
    """tensor -> shard; of a repeated tensor the later shard wins."""
    return tensors.groupBy("name").agg(F.max("shard").alias("shard"))


def total_size(tensors: DataFrame) -> DataFrame:
    return tensors.agg(F.sum(F.col("hi") - F.col("lo")).alias("total_size"))


def check_destination(path: str, protected: list[str]) -> str:
    """The resolved path, unless it is a root, a home, inside or above a protected tree, a git tree or a link."""
    real = os.path.realpath(path)
    if os.path.islink(path):
        raise AssemblyError(f"{path} is a link")
    if real in ("/", os.path.expanduser("~")):
        raise AssemblyError(f"{path} is a root or a home")
    if os.path.exists(os.path.join(real, ".git")):
        raise AssemblyError(f"{path} is a git tree")
    for p in map(os.path.realpath, protected):
        if os.path.commonpath([p, real]) in (p, real):
            raise AssemblyError(f"{path} overlaps {p}")
    return real


class StagedOutput:
    """An output built beside its destination and swapped in by two renames; a failure keeps the old one."""

    def __init__(self, path: str, overwrite: bool = False):
        self.path, self.overwrite, self.stage = path, overwrite, f"{path}.staged"

    def __enter__(self) -> str:
        if os.path.exists(self.path) and os.listdir(self.path):
            if not self.overwrite or not os.path.exists(os.path.join(self.path, SENTINEL)):
                raise AssemblyError(f"{self.path} isn't an output of ours, or overwriting wasn't asked for")
        shutil.rmtree(self.stage, ignore_errors=True)
        os.makedirs(self.stage)
        with open(os.path.join(self.stage, SENTINEL), "w"):
            pass
        return self.stage

    def __exit__(self, kind, *_):
        if kind is not None:
            shutil.rmtree(self.stage, ignore_errors=True)
            return
        old = f"{self.path}.old"
        shutil.rmtree(old, ignore_errors=True)
        if os.path.exists(self.path):
            os.rename(self.path, old)
        try:
            os.rename(self.stage, self.path)
        except OSError:
            if os.path.exists(old):
                os.rename(old, self.path)
            raise
        shutil.rmtree(old, ignore_errors=True)


def shard_pieces(assembled: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(requests, tensors) of the shards that override_join lays out: for each tensor where its bytes are (path, start,
    stop) and where they go. A tensor that its segment lacks is an error. assembled: override_join's rows with dtype,
    shape, source_path, source_offset and, where a segment overrides, segment_path and segment_lo."""
    bad = F.raise_error(F.concat(F.lit("missing tensor "), F.col("name"))).cast("string")
    routed = F.col("origin") == "segment"
    path = F.when(F.col("origin") == "missing", bad).when(routed, F.col("segment_path")).otherwise(F.col("source_path"))
    start = F.when(routed, F.col("segment_lo")).otherwise(F.col("source_offset") + F.col("old_lo"))
    rows = assembled.withColumn("path", path).withColumn("start", start).withColumn("stop", F.col("start") + F.col("new_size"))
    tensors = rows.select(F.col("shard").alias("file"), "name", "dtype", "shape", "new_lo", "new_hi")
    return rows.select(F.col("shard").alias("file"), "name", "path", "start", "stop", F.col("new_lo").alias("local_off"), F.col("new_size").alias("size")), tensors


def write_shards(assembled: DataFrame, read, folder: str, metadata: dict[str, str] | None = None) -> DataFrame:
    """Writes the shards into a folder that executors share; a row per shard with its measured digests.
    read(requests): rows (path, start, stop) with sha256 and content."""
    pieces, tensors = shard_pieces(assembled)
    layouts = header_json(tensors).withColumn("metadata", F.lit(json.dumps(metadata or {})))
    content = read(pieces.select("path", "start", "stop").distinct()).select("path", "start", "stop", "sha256", "content")
    return land(pieces.join(content, ["path", "start", "stop"]), layouts, folder)


def config_bits(policy: DataFrame) -> DataFrame:
    """One row: what a loader's config must say of the allocation: mixed, bits (the tier, or mixed) and its tiers."""
    ks = F.array_sort(F.collect_set("k"))
    one = policy.agg(ks.alias("k_values")).where(F.size("k_values") > 0)
    mixed = F.size("k_values") > 1
    return one.select(mixed.alias("mixed"), F.when(mixed, "mixed").otherwise(F.format_string("%.1f", F.col("k_values")[0].cast("double"))).alias("bits"), F.when(mixed, F.col("k_values")).alias("k_values"))


def synced_config(config: dict, bits: str | float, k_values: list[int] | None, reference: str, tail_key: str, stub: dict) -> dict:
    """A loader's config with every copy of the allocation brought up to date. reference: where a mixed map is found;
    stub: fields of quantization_config that are set only if they aren't there. A config without the tail stays."""
    out = json.loads(json.dumps(config))
    tail = out.get(tail_key)
    if not isinstance(tail, dict):
        return out
    mixed = k_values is not None
    tail["bits"] = bits
    for key, value in (("k_values", k_values), ("bits_per_expert", reference if mixed else None)):
        tail.pop(key, None)
        if value is not None:
            tail[key] = value
    quant = out.get("quantization_config")
    if not isinstance(quant, dict) and mixed:
        quant = out["quantization_config"] = {}
    if isinstance(quant, dict):
        quant["bits"] = bits
        for key, value in stub.items():
            quant.setdefault(key, value)
    return out


def tree_manifest(files: DataFrame, known: DataFrame | None = None, name: str = "MANIFEST.sha256") -> DataFrame:
    """line of each file (path, content) of a tree but the manifest itself, as sha256sum writes them, in order; a known
    digest (path, sha256) saves reading the file."""
    rows = files.where(F.col("path") != name)
    digest = F.sha2("content", 256)
    if known is not None:
        rows = rows.join(known.select("path", F.col("sha256").alias("known")), "path", "left")
        digest = F.coalesce("known", F.sha2("content", 256))
    return rows.select("path", F.concat(digest, F.lit("  "), F.col("path")).alias("line")).orderBy("path")


def assembly_record(policy: DataFrame, assembled_layers: DataFrame, fragments: DataFrame, products: DataFrame, recipe_sha256: str, manifest_sha256: str | None) -> DataFrame:
    """One row, record: how an assembly was made, as a struct to be signed: the recipe with its tiers and layers, the
    fragments used (layer, k, file, sha256, size), and the digests of what came out."""
    recipe = policy.agg(F.array_sort(F.collect_set("k")).alias("k_values"), F.array_sort(F.collect_set("layer")).alias("layers"))
    used = fragments.agg(F.array_sort(F.collect_list(F.struct("layer", "k", "file", "sha256", "size"))).alias("x"))
    made = products.agg(F.array_sort(F.collect_list(F.struct("file", "sha256"))).alias("x"))
    done = assembled_layers.agg(F.array_sort(F.collect_set("layer")).alias("x"))
    one = F.struct(F.lit(recipe_sha256).alias("sha256"), "k_values", "layers", done.scalar().alias("layers_assembled"))
    materials = F.struct(used.scalar().alias("fragments"), F.lit(manifest_sha256).cast("string").alias("manifest_sha256"))
    return recipe.select(F.struct(F.lit("assembly-of").alias("predicate"), one.alias("recipe"), materials.alias("materials"), made.scalar().alias("products")).alias("record"))


def protected_paths(start: str, more: list[str]) -> list[str]:
    """Trees that no output may touch: the given ones, and the checkout that holds ``start``."""
    at, out = os.path.realpath(start), [os.path.realpath(p) for p in more]
    while True:
        if os.path.exists(os.path.join(at, ".git")):
            out.append(at)
        if os.path.dirname(at) == at:
            return out
        at = os.path.dirname(at)
