import hashlib
import random
import re

import pytest

from fragmill.llm import fingerprint
from fragmill.llm.fingerprint import fingerprints


def pieces(t):
    return {s for s in re.split(r"\n|(?<=[.;:!?])\s+", t) if s.strip(" ")}


def like(a, b):
    a, b = pieces(a), pieces(b)
    return 2 * len(a & b) / (len(a) + len(b)) if a or b else 1.0


def brute(rows):
    rows = sorted(((i, t or "") for i, t in rows), key=lambda r: -r[0])
    out = []
    for j, (i, t) in enumerate(rows):
        nxt = rows[(j + 1) % len(rows)][1]
        k = len(t) // 2
        e = t[: len(t) - k] + nxt[:k]
        out.append((i, len(t), hashlib.sha256(e.encode()).hexdigest(), round(like(t, e), 9), round(like(t, nxt), 9)))
    return sorted(out)


@pytest.mark.parametrize("size", [2 << 20, 4000])
def test_against_brute_force(spark, size, monkeypatch):
    monkeypatch.setattr(fingerprint.with_next, "__defaults__", (size,))
    rnd = random.Random(size)
    vocab = ["alpha", "beta,", "gamma.", "δέλτα", "ε!\n", "x", "𝒳y."]
    rows = [(i * 7 - 100, " ".join(rnd.choice(vocab) + str(rnd.randrange(40)) for _ in range(rnd.randrange(0, 120)))) for i in range(150)]
    rows += [(9000, None), (9001, ""), (9002, "one two"), (9003, rows[5][1]), (9004, rows[5][1]), (9005, " ".join(f"w{i}." for i in range(4000))), (10**15, "z. y. x.")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as range", "2 as keys").repartition(5)
    got = fingerprints(df).collect()
    assert sorted((r.doc_id, r.n_chars, r.edited_sha256, round(r.near_edited, 9), round(r.near_next, 9)) for r in got) == brute(rows)
    by = {r.doc_id: r.fingerprint for r in got}
    assert by[9003] == by[9004] == by[5 * 7 - 100] and len(set(by.values())) > 140


def test_empty_single_and_repeated_rows(spark):
    assert fingerprints(spark.createDataFrame([], "doc_id long, text string")).collect() == []
    one = fingerprints(spark.createDataFrame([(1, "a. b. c.")], "doc_id long, text string")).collect()[0]
    assert one.near_next == 1.0 and one.n_chars == 8
    rows = [(3, "a. b."), (3, "a. b."), (None, "q."), (None, None), (1, "c.")]
    assert len(fingerprints(spark.createDataFrame(rows, "doc_id long, text string")).collect()) == 5


def test_plan_has_no_python(spark):
    df = spark.createDataFrame([(1, "a."), (2, "b.")], "doc_id long, text string")
    plan = fingerprints(df)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan.split("== Physical Plan ==")[1])


def test_a_hot_id_is_cut(spark, monkeypatch):
    """A third of the rows without an id, and an id with many texts: spread over ranges, in the defined order."""
    monkeypatch.setattr(fingerprint.with_next, "__defaults__", (1500,))
    rnd = random.Random(6)
    text = lambda: " ".join(f"w{rnd.randrange(99)}." for _ in range(rnd.randrange(1, 25)))
    rows = [(None, text()) for _ in range(120)] + [(77, text()) for _ in range(80)] + [(i, text()) for i in range(150)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    dealt = fingerprint.with_next(df)
    sizes = [r["count"] for r in dealt.groupBy("range").count().collect()]
    assert len(sizes) > 10 and max(sizes) < 70
    hashed = {(r.doc_id, r.text): r.h for r in df.selectExpr("doc_id", "text", "xxhash64(text) as h").collect()}
    ordered = sorted(rows, key=lambda r: (-(r[0] if r[0] is not None else -(2**63)), hashed[r], r[1]))
    want = []
    for (i, t), (_, nxt) in zip(ordered, ordered[1:] + ordered[:1]):
        k = len(t) // 2
        want.append((str(i), hashlib.sha256((t[: len(t) - k] + nxt[:k]).encode()).hexdigest()))
    assert sorted((str(r.doc_id), r.edited_sha256) for r in fingerprints(df).collect()) == sorted(want)
