"""Constraint checks as violation rows: subject columns and ``rule``; an empty result is a pass."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fragmill.functions.names import is_commit, is_sha256, is_utc
from fragmill.operators.release import same


class Violation(Exception):
    """Raised where a check that must be clean isn't."""


class TrustError(Violation):
    pass


class ProvenanceError(Violation):
    pass


class SourceLayoutError(Violation):
    pass


class AssemblyError(Violation):
    pass


class VerificationError(Violation):
    pass


class SegmentIntegrityError(Violation):
    pass


class SelectionError(Violation):
    pass


def assert_clean(df: DataFrame, error: type[Violation] = Violation, show: int = 20) -> None:
    """Raises with the first violations, if there is any."""
    rows = df.limit(show).collect()
    if rows:
        raise error("; ".join(str(r.asDict()) for r in rows))


def first_rule(*rules: tuple[Column, str]) -> Column:
    """The name of the first condition that is not true; NULL conditions fail."""
    out = F.lit(None).cast("string")
    for condition, name in reversed(rules):
        out = F.when(~F.coalesce(condition, F.lit(False)), name).otherwise(out)
    return out


def unique_violations(df: DataFrame, key: list[str]) -> DataFrame:
    return df.groupBy(*key).agg(F.count("*").alias("held")).where("held > 1")


def topology_violations(tensors: DataFrame, ranks: int = 4) -> DataFrame:
    """(layer, expert, proj, comp) whose ranks aren't exactly 0 .. ranks - 1, or whose packed shapes are wrong."""
    want = F.array(*(F.lit(i) for i in range(ranks)))
    bad = (F.col("comp") == "trellis") & ~((F.col("dtype") == "I16") & (F.size("shape") == 3) & (F.element_at("shape", -1) % 16 == 0))
    g = tensors.groupBy("layer", "expert", "proj", "comp").agg(F.sort_array(F.collect_set("rank")).alias("ranks"), F.count("*").alias("n"), F.bool_or(F.coalesce(bad, F.lit(True))).alias("bad"))
    return g.withColumn("rule", first_rule((F.col("ranks") == want, "ranks"), (F.col("n") == ranks, "repeated rank"), (~F.col("bad"), "packed shape"))).where("rule is not null")


def scale_violations(tensors: DataFrame) -> DataFrame:
    """Slots whose input and output scales don't have 16 values for each row and column of the packed tensor."""
    slot = ["layer", "expert", "proj", "rank"]
    size = {c: F.max(F.when(F.col("comp") == c, F.element_at("shape", 1))) for c in ("suh", "svh")}
    trellis = F.max(F.when(F.col("comp") == "trellis", F.col("shape")))
    g = tensors.groupBy(*slot).agg(trellis.alias("t"), *(x.alias(c) for c, x in size.items()))
    rule = first_rule((F.col("suh") == 16 * F.element_at("t", 1), "suh"), (F.col("svh") == 16 * F.element_at("t", 2), "svh"))
    return g.withColumn("rule", rule).where("rule is not null").drop("t")


def topology_differences(a: DataFrame, b: DataFrame) -> DataFrame:
    """Slots of which two sources differ in dtype or in shape up to the tier's dimension."""
    slot = ["layer", "expert", "proj", "rank", "comp"]
    x, y = (t.select(*slot, F.col("dtype").alias(f"d{i}"), F.slice("shape", 1, 2).alias(f"s{i}")) for i, t in enumerate((a, b)))
    return x.join(y, slot, "full").where(~(same(F.col("d0"), F.col("d1")) & same(F.col("s0"), F.col("s1"))))


def layer_analysis(tensors: DataFrame, shared: DataFrame) -> DataFrame:
    """Per layer: components of a slot, tiers of an expert, shared rows, and the layout that follows."""
    slots = tensors.groupBy("layer", "expert", "proj", "rank").agg(F.array_join(F.sort_array(F.collect_set("comp")), ",").alias("comps"))
    tiers = tensors.groupBy("layer", "expert").agg(F.countDistinct("k").alias("tiers"))
    a = slots.groupBy("layer").agg(F.countDistinct("comps").alias("signatures"), F.max(F.size(F.split("comps", ","))).alias("components"))
    b = tiers.groupBy("layer").agg(F.max("tiers").alias("tiers"))
    c = shared.groupBy("layer").agg(F.count("*").alias("shared_rows"))
    out = a.join(b, "layer").join(c, "layer", "left").fillna(0, ["shared_rows"])
    return out.withColumn("layout", F.when(F.col("shared_rows") > 0, "shared_h_v1").otherwise("per_expert_v1"))


def bitmap_agreement(tiers: DataFrame, bitmap: DataFrame) -> DataFrame:
    """Per layer: agrees, MISMATCH(len..), MISMATCH(n experts) or no-tier-bitmap. bitmap: layer, k array."""
    a = tiers.groupBy("layer").agg(F.transform(F.array_sort(F.collect_list(F.struct("expert", "k"))), lambda x: x.k).alias("have"))
    both = a.join(bitmap.select("layer", F.col("k").alias("want")), "layer", "left")
    wrong = F.size(F.filter(F.zip_with("have", "want", lambda x, y: ~x.eqNullSafe(y)), lambda x: x))
    what = F.when(F.col("want").isNull(), "no-tier-bitmap").when(F.size("have") != F.size("want"), F.format_string("MISMATCH(len %d/%d)", F.size("have"), F.size("want"))).when(wrong > 0, F.format_string("MISMATCH(%d experts)", wrong))
    return both.select("layer", F.coalesce(what, F.lit("agrees")).alias("agreement"))


def effective_layout(evidence: DataFrame) -> DataFrame:
    """One row: the layout that the evidence supports; rank-sliced wins. evidence: layout, routed."""
    g = evidence.agg(F.collect_set("layout").alias("seen"), F.bool_or("routed").alias("routed"))
    none = F.when(F.col("routed"), F.raise_error(F.lit("routed experts without a layout")).cast("string")).otherwise(F.lit("dense"))
    return g.select(F.when(F.array_contains("seen", "rank_sliced"), "rank_sliced").when(F.size("seen") > 0, F.array_min("seen")).otherwise(none).alias("layout"))


def cardinality_violations(experts: DataFrame, policy: DataFrame, manifest: DataFrame | None = None) -> DataFrame:
    """Layers whose expert ids aren't dense, or whose policy (or manifest) has another length. Sparse ids
    establish nothing, so they fail."""
    g = experts.groupBy("layer").agg(F.min("expert").alias("lo"), F.max("expert").alias("hi"), F.countDistinct("expert").alias("n"))
    both = policy.groupBy("layer").agg(F.countDistinct("expert").alias("asked"), F.max("expert").alias("top")).join(g, "layer", "left")
    rules = [(F.col("n").isNotNull(), "no evidence"), ((F.col("lo") == 0) & (F.col("hi") == F.col("n") - 1), "not dense"), ((F.col("asked") == F.col("n")) & (F.col("top") == F.col("hi")), "policy length")]
    if manifest is not None:
        both = both.join(manifest.select("layer", F.col("experts").alias("declared")), "layer", "left")
        rules.append((F.col("declared").isNull() | (F.col("declared") == F.col("n")), "manifest"))
    return both.withColumn("rule", first_rule(*rules)).where("rule is not null").select("layer", "rule")


def identity_violations(payload: DataFrame) -> DataFrame:
    """Signed statements about a fragment that break the contract of their fields; the first rule that fails."""
    rules = (
        (F.col("predicate").isin("repack-of", "encode-of"), "predicate"),
        (F.col("file") == F.format_string("layer-%03d.k%d.safetensors", "layer", "k"), "file name"),
        (is_sha256(F.col("sha256")), "digest"),
        (F.col("size") > 0, "size"),
        (F.col("num_experts") > 0, "experts"),
        (F.forall(F.map_values("expert_sha256"), is_sha256), "expert digest"),
        (F.forall(F.map_keys("expert_sha256"), lambda x: x.rlike(r"^(0|[1-9][0-9]*)\z")), "expert id"),
        (is_utc(F.col("created_utc")), "time"),
        (F.size(F.map_keys("materials")) > 0, "materials"),
    )
    return payload.withColumn("rule", first_rule(*rules)).where("rule is not null")


def binding_violations(binding: DataFrame, providers: DataFrame) -> DataFrame:
    """Bindings (provider, manifest_sha256, sha256) to a provider that is absent, unpinned or has another
    manifest, or with a malformed digest."""
    p = providers.select("provider", "revision", F.col("manifest_sha256").alias("have"))
    rules = ((F.col("revision").isNotNull(), "no provider"), (is_commit(F.col("revision")), "not pinned"), (F.col("have") == F.col("manifest_sha256"), "manifest"), (is_sha256(F.col("sha256")), "digest"))
    return binding.join(p, "provider", "left").withColumn("rule", first_rule(*rules)).where("rule is not null").drop("revision", "have")


def fragment_binding(rows: DataFrame, fields: list[str]) -> DataFrame:
    """binding_ok: every field f equals want_f; absence is a mismatch. mismatch: the first that differs."""
    rule = first_rule(*((F.col(f) == F.col(f"want_{f}"), f) for f in fields))
    return rows.withColumn("mismatch", rule).withColumn("binding_ok", rule.isNull())


def pinned_violations(segments: DataFrame, fields: list[str]) -> DataFrame:
    """Segments that differ from the family's first segment (by layer and tier) in a pinned field."""
    first = segments.agg(*(F.min_by(f, F.struct("layer", "k")).alias(f"pin_{f}") for f in fields))
    both = segments.join(F.broadcast(first))  # one row
    return both.withColumn("rule", first_rule(*((F.col(f) == F.col(f"pin_{f}"), f) for f in fields))).where("rule is not null").drop(*(f"pin_{f}" for f in fields))


def digest_verdicts(rows: DataFrame, want: str = "want", got: str = "got") -> DataFrame:
    """verdict: ok, mismatch or missing (no digest on either side proves anything)."""
    missing = F.col(want).isNull() | F.col(got).isNull()
    return rows.withColumn("verdict", F.when(missing, "missing").when(F.col(want) == F.col(got), "ok").otherwise("mismatch"))


def verdict_summary(rows: DataFrame) -> DataFrame:
    """Rows checked, matched and failed; bytes of the matching ones where rows have a size."""
    size = [F.coalesce(F.sum(F.when(F.col("verdict") == "ok", F.col("size"))), F.lit(0)).alias("bytes")] if "size" in rows.columns else []
    return rows.agg(F.count("*").alias("checked"), F.count_if(F.col("verdict") == "ok").alias("matched"), F.count_if(F.col("verdict") != "ok").alias("failures"), *size)


def merge_attestations(digests: DataFrame) -> DataFrame:
    """Digests of each expert over all lines: conflicting or missing ones make the expert a reject."""
    g = digests.groupBy("fragment", "expert").agg(F.min("sha256").alias("lo"), F.max("sha256").alias("hi"), F.count_if(F.col("sha256").isNull()).alias("nulls"), F.count("*").alias("lines"))
    good = (F.col("nulls") == 0) & same(F.col("lo"), F.col("hi"))
    return g.select("fragment", "expert", F.when(good, F.col("lo")).alias("sha256"), "lines", (~good).alias("rejected"))


def partition_violations(parts: DataFrame, whole: DataFrame, by: list[str], item: str) -> DataFrame:
    """Groups whose parts don't cover exactly the whole, each item once."""
    a = parts.groupBy(*by, item).agg(F.count("*").alias("held"))
    b = whole.select(*by, item).distinct().withColumn("wanted", F.lit(1))
    both = a.join(b, [*by, item], "full").fillna(0, ["held", "wanted"])
    return both.groupBy(*by).agg(F.count_if(F.col("held") == 0).alias("missing"), F.count_if(F.col("held") > 1).alias("repeated"), F.count_if(F.col("wanted") == 0).alias("foreign")).where("missing + repeated + foreign > 0")


def trust_root_violations(keys: DataFrame, key_files: DataFrame) -> DataFrame:
    """Lines of a trust root that break its format, repeat a key or id, or don't pair with a key file."""
    shape = keys.select("fingerprint", "key_id", F.when(~F.coalesce(F.col("fingerprint").rlike(r"^[0-9a-f]{64}\z"), F.lit(False)), "fingerprint").when(~F.coalesce(F.col("status").isin("active", "retired", "revoked"), F.lit(False)), "status").when(~F.coalesce(F.col("added").rlike(r"^\d{4}-\d{2}-\d{2}\z"), F.lit(False)), "added").alias("rule")).where("rule is not null")
    none = F.lit(None).cast("string")
    twice = unique_violations(keys, ["fingerprint"]).select("fingerprint", none.alias("key_id"), F.lit("repeated fingerprint").alias("rule"))
    ids = unique_violations(keys, ["key_id"]).select(none.alias("fingerprint"), "key_id", F.lit("repeated id").alias("rule"))
    pair = keys.select("fingerprint", "key_id").join(key_files.select("fingerprint", F.lit(True).alias("file")), "fingerprint", "full")
    pair = pair.where("key_id is null or file is null").select("fingerprint", "key_id", F.when(F.col("file").isNull(), "no key file").otherwise("unlisted key file").alias("rule"))
    return shape.union(twice).union(ids).union(pair)
