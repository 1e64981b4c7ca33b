import random

import corpus_pipeline
from fragmill.llm.minhash import drawn, near_duplicates
from tests.llm.test_minhash import brute, shingles


def test_stage_takes_pairs_from_080(spark):
    rnd = random.Random(4)
    rows = []
    for i in range(0, 40, 2):
        words = [f"w{rnd.randrange(10**6)}" for _ in range(100)]
        other = list(words)
        other[30], other[60] = "x", "y"  # ten shingles of 96 change: 86 / 106 = 0.81
        rows += [(i, " ".join(words)), (i + 1, " ".join(other))]
    a, b = shingles(rows[0][1]), shingles(rows[1][1])
    assert 0.80 <= len(a & b) / len(a | b) < 0.85
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    assert sorted(r.doc_id for r in corpus_pipeline.near_dedup(spark, docs, "").collect()) == list(range(0, 40, 2))


def test_tables_follow_percent(spark):
    assert drawn(85) == (9, 20)
    assert drawn(80)[0] == 12
    rnd = random.Random(5)
    base = [f"w{rnd.randrange(400)}" for _ in range(60)]
    rows = [(i, " ".join(rnd.choice(base) if rnd.random() < 0.03 else w for w in base)) for i in range(80)]
    got = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), percent=60)
    assert sorted(tuple(r) for r in got.collect()) == brute(rows, 60)
