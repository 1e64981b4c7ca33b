"""Trust decisions: which key may sign, and which evidence is verified."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from fragmill.functions.crypto import envelope_verdict

LEAST_PREFIX = 16
RUNGS = ("pinned", "root", "declared", "none")


def resolve(requests: DataFrame, keys: DataFrame) -> DataFrame:
    """requests(request, signer): a full key, a prefix of at least LEAST_PREFIX digits, or a key id. Adds the
    key, its status and a decision: trusted, warned (retired), revoked, ambiguous, short or unknown. Ids and the
    first LEAST_PREFIX digits of keys are joined by equality, so that keys need not be few."""
    k = keys.select("fingerprint", "key_id", "status")
    s = F.lower("signer")
    hex_like = s.rlike(r"^[0-9a-f]+\z")
    asked = requests.select("request", "signer")
    by_id = asked.join(k, F.col("key_id") == F.col("signer"))
    head = F.when(hex_like & (F.length("signer") >= LEAST_PREFIX), F.substring(s, 1, LEAST_PREFIX))
    by_prefix = asked.withColumn("head", head).join(k, (F.substring("fingerprint", 1, LEAST_PREFIX) == F.col("head")) & F.col("fingerprint").startswith(s)).drop("head")
    hits = by_id.union(by_prefix).distinct().groupBy("request", "signer").agg(F.count("fingerprint").alias("hits"), F.min("fingerprint").alias("fingerprint"), F.min("status").alias("status"))
    found = asked.distinct().join(hits, ["request", "signer"], "left").fillna(0, ["hits"])
    short = hex_like & (F.length("signer") < LEAST_PREFIX)
    decision = (
        F.when((F.col("hits") == 0) & F.coalesce(short, F.lit(False)), "short")
        .when(F.col("hits") == 0, "unknown")
        .when(F.col("hits") > 1, "ambiguous")
        .when(F.col("status") == "revoked", "revoked")
        .when(F.col("status") == "retired", "warned")
        .when(F.col("status") == "active", "trusted")
        .otherwise("unknown")
    )
    return found.withColumn("decision", decision).withColumn("fingerprint", F.when(decision.isin("trusted", "warned"), F.col("fingerprint"))).drop("hits")


def rung(pinned: str | None, root: str | None, declared: str | None) -> tuple[str, str | None]:
    """The strongest ground on which a key is trusted. A declared key is only as good as its channel."""
    for name, key in zip(RUNGS, (pinned, root, declared)):
        if key:
            return name, key
    return "none", None


def verify_lines(lines: DataFrame, trusted: DataFrame) -> DataFrame:
    """lines(family, file, line_no, line), trusted(family, key): ok, reason and payload of every line."""
    rows = lines.join(trusted, "family", "left")
    return rows.withColumn("v", envelope_verdict("line", "key")).select("family", "file", "line_no", "v.ok", "v.reason", "v.payload")


def first_pinned(verified: DataFrame) -> DataFrame:
    """The first line of each file by a trusted key. Lines of other keys are passed over; a bad signature under
    a trusted key rejects the file."""
    bad = F.max(F.col("reason").isin("bad signature", "signature length", "bad base64")).over(W.partitionBy("family", "file"))
    rank = F.row_number().over(W.partitionBy("family", "file").orderBy(F.desc("ok"), "line_no"))
    out = verified.withColumn("rejected", bad).withColumn("rank", rank).where("rank = 1 and ok")
    return out.where(~F.col("rejected")).drop("rank", "rejected")


def attested_digests(verified: DataFrame) -> DataFrame:
    """family, file, expert, sha256 of the experts that verified lines speak for; the first line counts."""
    payload = F.from_json("payload", "expert_sha256 map<string,string>, layer int, k int")
    rows = verified.where("ok").withColumn("p", payload).select("family", "file", "line_no", "p.layer", "p.k", F.explode("p.expert_sha256").alias("expert", "sha256"))
    w = W.partitionBy("family", "file", "expert").orderBy("line_no")
    return rows.withColumn("n", F.row_number().over(w)).where("n = 1").select("family", "file", "layer", "k", F.col("expert").cast("int").alias("expert"), "sha256")


def summary(verified: DataFrame) -> DataFrame:
    """Counts by reason."""
    return verified.groupBy("reason").agg(F.count("*").alias("lines"))


def discover_root(explicit: str | None, environment: str | None, candidates: list[str], name: str = "FINGERPRINTS") -> str | None:
    """Where the trust root is: the explicit path, else the environment's, else the first candidate that exists (a
    checkout, a packaged snapshot); None without any. A path that was asked for and isn't there is fatal."""
    asked = explicit or environment
    for path in [asked] if asked else candidates:
        path = os.path.join(path, name) if os.path.isdir(path) else path
        if os.path.exists(path):
            return path
    if asked:
        raise FileNotFoundError(f"trust root {asked}")
    return None
