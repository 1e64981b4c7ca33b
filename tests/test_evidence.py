import random

import pytest
from pyspark.sql import functions as F

from fragmill.operators import evidence as E


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_interval_join_equals_brute_force(spark):
    rnd = random.Random(1)

    def spans(n):
        return [(rnd.choice("fg"), lo, lo + rnd.randrange(1, 90)) for lo in (rnd.randrange(0, 500) for _ in range(n))]

    a, b = spans(60), spans(60)
    frames = [spark.createDataFrame(sorted(set(x)), "file string, lo long, hi long") for x in (a, b)]
    want = sorted((f, lo, hi, lo2, hi2) for f, lo, hi in set(a) for g, lo2, hi2 in set(b) if f == g and lo < hi2 and lo2 < hi)
    assert rows(E.interval_join(*frames, ["file"], 32).select("file", "a_lo", "a_hi", "b_lo", "b_hi")) == want
    parts = E.chunk_overlaps(frames[0], 32, ["file"]).groupBy("file", "lo", "hi").agg(F.sum(F.col("part_hi") - F.col("part_lo")).alias("n"))
    assert parts.where("n <> hi - lo").count() == 0


def test_lookups(spark):
    idx = spark.createDataFrame([(3, "i")], "k int, v string")
    st = spark.createDataFrame([(3, "s"), (4, "s")], "k int, v string")
    assert rows(E.index_or_state(idx, st)) == [(3, "i"), (4, "s")]
    t = spark.createDataFrame([("a",), ("b",)], "name string")
    m = spark.createDataFrame([("a", "s1")], "name string, shard string")
    assert rows(E.weight_lookup(t.where("name = 'a'"), m)) == [("a", "s1")]
    with pytest.raises(Exception, match="no shard"):
        E.weight_lookup(t, m).collect()
    sh = spark.createDataFrame([("p", "x"), ("q", "y"), ("r", None)], "path string, sha256 string")
    de = spark.createDataFrame([("p", "x"), ("q", "z"), ("r", "z")], "path string, sha256 string")
    assert {r.path: r.rule for r in E.declared_digests(sh, de).collect()} == {"p": None, "q": "conflict", "r": "conflict"}


def test_header_ladder(spark):
    cases = [("auto", "d", "d", None, None, "digest"), ("auto", None, "d", "w", "w", "full"), ("auto", "x", "d", "w", "w", "refused"), ("digest", None, "d", "w", "w", "refused"), ("full", None, None, "w", "w", "full"), ("full", None, None, None, None, "refused"), ("unsafe", None, None, None, None, "unsafe")]
    df = spark.createDataFrame(cases, "q string, a string, g string, w string, h string, want string")
    assert df.where(E.header_method(*(F.col(c) for c in "qagwh")) != F.col("want")).count() == 0


def test_cardinality_and_completed(spark):
    p = [(1, 0, 2, 2, 2, 2, "f"), (1, 1, 2, 2, 2, None, "f"), (2, 5, 4, 4, 4, 4, "f"), (3, 0, None, 1, 1, 1, "f"), (4, 0, 3, 9, 1, 3, "f"), (5, 0, 3, 3, 3, 3, "f"), (5, 1, 3, 3, 3, 3, "g")]
    df = spark.createDataFrame(p, "layer int, expert int, signed int, header int, held int, manifest int, family string")
    assert rows(E.authenticated_cardinality(df)) == [(2, "expert out of bounds"), (3, "unsigned"), (4, "header"), (5, "families")]
    e = spark.createDataFrame([("a", "h", 1, "x"), ("b", "h", 1, "x"), ("c", "h", 1, None), ("d", "h", 1, "x")], "file string, header_sha256 string, size int, experts_digest string")
    f = spark.createDataFrame([("a", "h", 1, "x"), ("b", "h", 2, "x"), ("c", "h", 1, None)], "file string, header_sha256 string, size int, experts_digest string")
    assert {r.file: r.rule for r in E.completed_entries(e, f).collect()} == {"a": None, "b": "size", "c": "experts", "d": "no file"}
    c = spark.createDataFrame([("a", "r1", "x"), ("b", "r1", "y")], "path string, revision string, v string")
    n = spark.createDataFrame([("a", "r1"), ("b", "r2")], "path string, revision string")
    assert rows(E.cache_fits(c, n, ["revision"]).select("path")) == [("a",)]
