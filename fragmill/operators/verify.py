"""Identity proofs as verdict rows (check, subject, verdict, reason) and their reports."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from fragmill.functions.digest import group_digest
from fragmill.operators.checks import digest_verdicts


def identity_local(index: DataFrame, attested: DataFrame, recomputed: DataFrame) -> DataFrame:
    """Indexed spans against signed and recomputed digests. All three must agree; absence fails."""
    key = ["layer", "k", "expert"]
    rows = index.join(attested.select(*key, F.col("sha256").alias("want")), key, "left").join(recomputed.select(*key, F.col("sha256").alias("got")), key, "left")
    return digest_verdicts(rows).withColumn("check", F.lit("identity.local"))


def identity_remote(local: DataFrame, fresh: DataFrame) -> DataFrame:
    """Tensors of a segment against freshly read source bytes, by name; tensors of one side only fail."""
    rows = local.select("name", F.col("sha256").alias("want")).join(fresh.select("name", F.col("sha256").alias("got")), "name", "full")
    return digest_verdicts(rows).withColumn("check", F.lit("identity.remote"))


def identity_derived(expanded: DataFrame, parent: DataFrame, profile: DataFrame) -> DataFrame:
    """Expanded tensors against the parent's, else against the layer's shared profile."""
    slot = ["layer", "proj", "rank", "comp"]
    p = parent.select("layer", "expert", "proj", "rank", "comp", F.col("sha256").alias("own"))
    s = profile.select(*slot, F.col("sha256").alias("common"))
    rows = expanded.join(p, ["layer", "expert", *slot[1:]], "left").join(s, slot, "left")
    return digest_verdicts(rows.select("layer", "expert", "proj", "rank", "comp", F.coalesce("own", "common").alias("want"), F.col("sha256").alias("got"))).withColumn("check", F.lit("identity.derived"))


def identity_fetched(child: DataFrame, parents: DataFrame) -> DataFrame:
    """Each expert of a fetched subset against its publisher's verified statement; exactly one parent must
    speak for it."""
    p = parents.groupBy("layer", "k", "expert").agg(F.count("*").alias("hops"), F.min("sha256").alias("want"))
    rows = child.join(p, ["layer", "k", "expert"], "left").withColumnRenamed("sha256", "got")
    out = digest_verdicts(rows)
    return out.withColumn("verdict", F.when(F.coalesce("hops", F.lit(0)) != 1, "uncovered").otherwise(F.col("verdict"))).withColumn("check", F.lit("identity.fetched"))


def sample(rows: DataFrame, by: str, n: int, seed: int, key: str) -> DataFrame:
    """n rows of each group in an order that only depends on the seed and the key."""
    order = F.sha2(F.concat_ws(":", F.lit(seed), F.col(key).cast("string")), 256)
    return rows.withColumn("rank", F.row_number().over(W.partitionBy(by).orderBy(order, key))).where(F.col("rank") <= n).drop("rank")


def quota_sample(rows: DataFrame, by: str, total: int, seed: int, key: str) -> DataFrame:
    """About ``total`` rows spread evenly: the first total % groups groups give one more."""
    groups = rows.select(by).distinct().withColumn("place", F.row_number().over(W.orderBy(by)) - 1).withColumn("groups", F.count("*").over(W.partitionBy()))
    quota = F.floor(F.lit(total) / F.col("groups")) + F.when(F.col("place") < F.lit(total) % F.col("groups"), 1).otherwise(0)
    order = F.sha2(F.concat_ws(":", F.lit(seed), F.col(key).cast("string")), 256)
    ranked = rows.join(groups, by).withColumn("rank", F.row_number().over(W.partitionBy(by).orderBy(order, key)))
    return ranked.where(F.col("rank") <= quota).drop("rank", "place", "groups")


def detect_check(has_parents: bool, has_remote: bool, has_profile: bool, has_subset: bool) -> str:
    """Which proof fits what is given."""
    if has_subset:
        return "identity.fetched"
    if has_parents or has_profile:
        return "identity.derived"
    return "identity.remote" if has_remote else "identity.local"


def report(rows: DataFrame) -> DataFrame:
    """Per check: rows, matches and failures by verdict; the rows themselves stay a table."""
    return rows.groupBy("check", "verdict").agg(F.count("*").alias("rows"))


def report_json(rows: DataFrame) -> str:
    got = [r.asDict() for r in report(rows).orderBy("check", "verdict").collect()]
    return json.dumps({"summary": got, "failures": sum(r["rows"] for r in got if r["verdict"] != "ok")}, sort_keys=True)


def report_markdown(rows: DataFrame) -> str:
    lines = ["| check | verdict | rows |", "| - | - | - |"]
    lines += [f"| {r.check} | {r.verdict} | {r.rows} |" for r in report(rows).orderBy("check", "verdict").collect()]
    return "\n".join(lines)


def fresh_digests(tensors: DataFrame, read) -> DataFrame:
    """name, sha256 of tensors (name, path, start, stop) as their bytes are read now. read(requests): see
    sources.read_spans, without content."""
    got = read(tensors.select("path", "start", "stop").distinct()).select("path", "start", "stop", "sha256")
    return tensors.join(got, ["path", "start", "stop"], "left").select("name", "sha256")


def reassembled_digests(pieces: DataFrame, read) -> DataFrame:
    """file, digest of files put together from pieces (file, place, path, start, stop) in order of place, as one stream
    a file; nothing is written. A piece that can't be read is an error."""
    got = read(pieces.select("path", "start", "stop").distinct()).select("path", "start", "stop", "content")
    rows = pieces.join(got, ["path", "start", "stop"], "left")
    missing = F.raise_error(F.concat(F.lit("no bytes of "), F.col("path"))).cast("binary")
    return group_digest(rows.withColumn("content", F.coalesce("content", missing)), ["file"], "place", "content")
