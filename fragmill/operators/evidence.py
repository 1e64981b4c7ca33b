"""Evidence ladders and lookups around a plan: header proofs, caches, declared digests, interval joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fragmill.operators.checks import first_rule
from fragmill.operators.release import same


def index_or_state(index: DataFrame, state: DataFrame) -> DataFrame:
    """Index rows, and state rows of the tiers that have no index."""
    return index.unionByName(state.join(index.select("k").distinct(), "k", "left_anti"))


def weight_lookup(tensors: DataFrame, weight_map: DataFrame) -> DataFrame:
    """tensors with the shard that holds them; a tensor without a shard is an error."""
    both = tensors.join(weight_map.select("name", F.col("shard").alias("_shard")), "name", "left")
    bad = F.raise_error(F.concat(F.lit("no shard for "), F.col("name"))).cast("string")
    return both.withColumn("shard", F.coalesce("_shard", bad)).drop("_shard")


def chunk_overlaps(spans: DataFrame, chunk: int, by: list[str]) -> DataFrame:
    """Each span's parts by fixed chunk of its file: an interval join as an equality of chunk numbers, so that
    it shuffles on (file, chunk)."""
    first, last = F.floor(F.col("lo") / chunk), F.floor((F.greatest(F.col("hi"), F.col("lo") + 1) - 1) / chunk)
    rows = spans.withColumn("chunk", F.explode(F.sequence(first, last)))
    return rows.select(*spans.columns, "chunk", F.greatest(F.col("lo"), F.col("chunk") * chunk).alias("part_lo"), F.least(F.col("hi"), (F.col("chunk") + 1) * chunk).alias("part_hi"))


def interval_join(a: DataFrame, b: DataFrame, by: list[str], chunk: int) -> DataFrame:
    """Pairs of rows of a and b (lo, hi) in the same file that overlap, each pair once."""
    x = chunk_overlaps(a, chunk, by).drop("part_lo", "part_hi").withColumnsRenamed({"lo": "a_lo", "hi": "a_hi"})
    y = chunk_overlaps(b, chunk, by).drop("part_lo", "part_hi").withColumnsRenamed({"lo": "b_lo", "hi": "b_hi"})
    met = x.join(y, [*by, "chunk"]).where("a_lo < b_hi and b_lo < a_hi")
    return met.where(F.col("chunk") == F.floor(F.greatest("a_lo", "b_lo") / chunk)).drop("chunk")


def declared_digests(shards: DataFrame, declared: DataFrame) -> DataFrame:
    """rule: conflict where a declared digest differs from the computed one; an undeclared shard is fine."""
    both = shards.join(declared.select("path", F.col("sha256").alias("declared")), "path", "left")
    return both.withColumn("rule", F.when(F.col("declared").isNotNull() & ~same(F.col("declared"), F.col("sha256")), "conflict"))


def header_method(requested: Column, attested: Column, got: Column, whole_want: Column, whole_got: Column) -> Column:
    """How a header is proven: digest (attested header digest), full (whole fragment), unsafe, or refused.
    requested: auto, digest, full or unsafe."""
    by_digest, by_whole = same(attested, got), same(whole_want, whole_got)
    return (
        F.when(requested == "unsafe", "unsafe")
        .when((requested == "digest") & by_digest, "digest")
        .when((requested == "full") & by_whole, "full")
        .when((requested == "auto") & by_digest, "digest")
        .when((requested == "auto") & attested.isNull() & by_whole, "full")
        .otherwise("refused")
    )


def cache_fits(cached: DataFrame, now: DataFrame, fields: list[str]) -> DataFrame:
    """Cached rows that state the identity that is asked for; others are ignored."""
    n = now.select("path", *(F.col(f).alias(f"now_{f}") for f in fields))
    both = cached.join(n, "path")
    rule = first_rule(*((F.col(f) == F.col(f"now_{f}"), f) for f in fields))
    return both.where(rule.isNull()).drop(*(f"now_{f}" for f in fields))


def authenticated_cardinality(plans: DataFrame) -> DataFrame:
    """Per layer: rule if ids exceed the signed number of experts, the header's number is neither the held nor
    the signed one, the manifest disagrees, or plans belong to several families.
    plans(layer, expert, signed, header, held, manifest, family)."""
    g = plans.groupBy("layer").agg(
        F.max("expert").alias("top"),
        F.min("signed").alias("s_lo"),
        F.max("signed").alias("s_hi"),
        F.count_if(F.col("signed").isNull()).alias("unsigned"),
        F.bool_and((F.col("header") == F.col("signed")) | (F.col("header") == F.col("held"))).alias("header_ok"),
        F.bool_and(F.col("manifest").isNull() | (F.col("manifest") == F.col("signed"))).alias("manifest_ok"),
        F.countDistinct("family").alias("families"),
    )
    rules = ((F.col("unsigned") == 0, "unsigned"), (F.col("s_lo") == F.col("s_hi"), "signed counts differ"), (F.col("top") < F.col("s_lo"), "expert out of bounds"), (F.col("header_ok"), "header"), (F.col("manifest_ok"), "manifest"), (F.col("families") == 1, "families"))
    return g.withColumn("rule", first_rule(*rules)).where("rule is not null").select("layer", "rule")


def completed_entries(entries: DataFrame, files: DataFrame) -> DataFrame:
    """Finished outputs with why they can't be trusted again (header, size or an expert's digest); NULL if they
    can. files has what was measured anew, experts as one digest over (expert, sha256) in order."""
    f = files.select("file", F.col("header_sha256").alias("f_header"), F.col("size").alias("f_size"), F.col("experts_digest").alias("f_experts"))
    both = entries.join(f, "file", "left")
    rule = first_rule((F.col("f_size").isNotNull(), "no file"), (F.col("header_sha256") == F.col("f_header"), "header"), (F.col("size") == F.col("f_size"), "size"), (F.col("experts_digest") == F.col("f_experts"), "experts"))
    return both.withColumn("rule", rule).drop("f_header", "f_size", "f_experts")


def experts_digest(experts: DataFrame, by: list[str]) -> DataFrame:
    pairs = F.array_sort(F.collect_list(F.struct("expert", F.coalesce("sha256", F.lit("")).alias("sha256"))))
    return experts.groupBy(*by).agg(F.sha2(F.to_json(pairs), 256).alias("experts_digest"))


def proven_headers(files: DataFrame, read) -> DataFrame:
    """path, method: how each file's header is proven, from bytes read now. files(path, size, body_offset, requested,
    attested, whole): the attested digests of the header and of the whole file. Whole files are only read where the
    header's digest can't decide. read(requests): see sources.read_spans, without content."""
    head = read(files.select("path", F.lit(0).alias("start"), F.col("body_offset").alias("stop"))).select("path", F.col("sha256").alias("got"))
    both = files.join(head, "path", "left")
    needs = (F.col("requested") == "full") | ((F.col("requested") == "auto") & F.col("attested").isNull())
    full = read(files.where(needs).select("path", F.lit(0).alias("start"), F.col("size").alias("stop"))).select("path", F.col("sha256").alias("got_whole"))
    both = both.join(full, "path", "left")
    return both.select("path", header_method(F.col("requested"), F.col("attested"), F.col("got"), F.col("whole"), F.col("got_whole")).alias("method"))
