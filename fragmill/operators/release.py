"""Signed file lists: counts, comparison with a tree or a remote, commit plans, coverage.

A NULL digest never equals anything, another NULL included.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fragmill.functions.crypto import check_envelope, sign_envelope

MOST_BLOB = 16 << 20


def same(a: Column, b: Column) -> Column:
    """Equality in which missing evidence fails."""
    return F.coalesce(a == b, F.lit(False))


def counts(files: DataFrame, fragment_suffix: str = ".safetensors") -> DataFrame:
    return files.agg(F.count("*").alias("files"), F.count_if(F.col("path").endswith(fragment_suffix)).alias("fragments"), F.coalesce(F.sum("size"), F.lit(0)).alias("bytes"))


def is_excluded(path: Column, names: list[str], suffixes: list[str], folders: list[str]) -> Column:
    name = F.element_at(F.split(path, "/"), -1)
    out = name.isin(names) if names else F.lit(False)
    for s in suffixes:
        out = out | name.endswith(s)
    for f in folders:
        out = out | F.exists(F.slice(F.split(path, "/"), F.lit(1), F.greatest(F.size(F.split(path, "/")) - 1, F.lit(0))), lambda x, f=f: x == f)
    return out


def compare(listed: DataFrame, tree: DataFrame) -> DataFrame:
    """path, status: ok, bad (size or digest), missing (listed only) or extra (in the tree only)."""
    a = listed.select("path", F.col("sha256").alias("want"), F.col("size").alias("want_size"), F.lit(True).alias("listed"))
    b = tree.select("path", F.col("sha256").alias("got"), F.col("size").alias("got_size"), F.lit(True).alias("found"))
    good = same(F.col("want"), F.col("got")) & same(F.col("want_size"), F.col("got_size"))
    status = F.when(F.col("found").isNull(), "missing").when(F.col("listed").isNull(), "extra").when(good, "ok").otherwise("bad")
    return a.join(b, "path", "full").select("path", status.alias("status"))


def verdict(statuses: DataFrame) -> DataFrame:
    """One row: strict (nothing extra either) and lenient verdict. An empty list fails both."""
    n = {s: F.count_if(F.col("status") == s) for s in ("ok", "bad", "missing", "extra")}
    out = statuses.agg(*(x.alias(s) for s, x in n.items()))
    fine = (F.col("ok") > 0) & (F.col("bad") == 0) & (F.col("missing") == 0)
    return out.withColumn("lenient", fine).withColumn("strict", fine & (F.col("extra") == 0))


def remote_is_current(size: Column, sha256: Column, blob: Column, lfs: Column, remote_blob: Column) -> Column:
    """A remote file is the same: by its large-file digest, else by its blob id if it is small enough."""
    return F.when(lfs.isNotNull(), same(lfs, sha256)).otherwise(F.coalesce(size <= MOST_BLOB, F.lit(False)) & same(blob, remote_blob))


def commit_plan(listed: DataFrame, remote: DataFrame) -> DataFrame:
    """path, action: upload, keep or delete (a remote file that the list doesn't have)."""
    r = remote.select("path", F.col("lfs"), F.col("blob").alias("remote_blob"), F.lit(True).alias("there"))
    both = listed.withColumn("listed", F.lit(True)).join(r, "path", "full")
    current = F.coalesce(remote_is_current(F.col("size"), F.col("sha256"), F.col("blob"), F.col("lfs"), F.col("remote_blob")), F.lit(False))
    action = F.when(F.col("listed").isNull(), "delete").when(F.col("there").isNull(), "upload").when(current, "keep").otherwise("upload")
    return both.select("path", action.alias("action"))


def coverage_state(listed_sha: Column, listed_size: Column, sha256: Column, size: Column) -> Column:
    """covered, uncovered (not listed) or conflict."""
    return F.when(listed_sha.isNull() & listed_size.isNull(), "uncovered").when(same(listed_sha, sha256) & same(listed_size, size), "covered").otherwise("conflict")


def cross_check(files: DataFrame, release: DataFrame, strict: bool = False) -> DataFrame:
    """State of each file against a release, and whether it fails (a conflict; when strict, uncovered too)."""
    r = release.select("path", F.col("sha256").alias("l_sha"), F.col("size").alias("l_size"))
    out = files.join(r, "path", "left").withColumn("state", coverage_state(F.col("l_sha"), F.col("l_size"), F.col("sha256"), F.col("size")))
    return out.drop("l_sha", "l_size").withColumn("fails", (F.col("state") == "conflict") | ((F.col("state") == "uncovered") & F.lit(strict)))


def expert_covered(files: DataFrame) -> DataFrame:
    """Fragments of which both the segment and its evidence are covered: files(fragment, role, state)."""
    ok = [F.coalesce(F.bool_or((F.col("role") == r) & (F.col("state") == "covered")), F.lit(False)) for r in ("segment", "attestation")]
    return files.groupBy("fragment").agg((ok[0] & ok[1]).alias("covered"))


def coverage_required(revision: str, tag: str | None, parent: str | None, release_revision: str) -> bool:
    """Whether a source's files must be in a release: it names the source's commit, its parent, or its tag."""
    return release_revision in {x for x in (revision, tag, parent) if x}


def publish(read_head, build, commit, tries: int = 5):
    """Optimistic publication: read the head, build against it, commit with it as parent; a stale parent is
    tried again, a bounded number of times. commit(head, payload) returns False when the head has moved."""
    for _ in range(tries):
        head = read_head()
        payload = build(head)
        if commit(head, payload):
            return payload
    raise RuntimeError(f"the head moved {tries} times")


def build_payload(files: DataFrame, schema: str, name: str, created: Column, repo: str | None = None, revision: str | None = None, manifest: str = "manifest.json") -> DataFrame:
    """One row, payload: the list of all files with their digests and sizes, its counts, and the manifest's digest
    (NULL without one), as a struct to be signed. files: path, sha256, size."""
    listed = F.map_from_entries(F.array_sort(F.collect_list(F.struct("path", F.struct("sha256", "size").alias("f")))))
    one = files.agg(listed.alias("files"), F.max(F.when(F.col("path") == manifest, F.col("sha256"))).alias("manifest_sha256"))
    n = counts(files).select(F.struct("files", "fragments", "bytes").alias("n"))
    fields = {"schema": F.lit(schema), "release": F.lit(name), "created_utc": created, "counts": n.scalar(), "files": F.col("files"), "manifest_sha256": F.col("manifest_sha256"), "repo": F.lit(repo), "revision": F.lit(revision)}
    return one.select(F.struct(*(v.alias(k) for k, v in fields.items())).alias("payload"))


def sign_payload(payload: DataFrame, seed: bytes) -> dict:
    """The envelope of a one-row payload; fields without a value are left out. A list of files is one document by
    nature, so it is signed on the driver, where the seed stays."""
    text = payload.select(F.to_json("payload")).first()[0]
    return sign_envelope(seed, json.loads(text))


def verify_release(line: str, trusted: str, schema: str) -> dict:
    """The payload of a release envelope under a trusted key; refuses another schema and an empty list."""
    ok, reason, text = check_envelope(line, trusted)
    if not ok:
        raise PermissionError(f"release: {reason}")
    payload = json.loads(text)
    if payload.get("schema") != schema or not isinstance(payload.get("files"), dict) or not payload["files"]:
        raise PermissionError("release: another schema, or no files")
    return payload
