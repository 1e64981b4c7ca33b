import random
import zlib

import numpy as np
import pyarrow as pa

from fragmill.llm import quality, toxicity
from fragmill.llm.toxicity import Trees, isotonic

WORDS = "the of and to in is that it was for on are with as be at one have this from".split()


def corpus(n, seed=1):
    rnd = random.Random(seed)
    rows, labels = [], []
    for i in range(n):
        w = [rnd.choice(WORDS) + rnd.choice(["", "", "er", "ing"]) for _ in range(rnd.randrange(20, 200))]
        toxic, good = rnd.random() < 0.2, rnd.random() < 0.8
        if toxic:
            for _ in range(3):
                w.insert(rnd.randrange(len(w)), rnd.choice(["blorg", "snarf", "yuckster"]))
        if not good:
            kind = rnd.randrange(3)
            w = [x.upper() + "!!" for x in w] if kind == 0 else [w[0]] * len(w) if kind == 1 else [x + " |" for x in w]
        rows.append((i, " ".join(w)))
        labels.append((i, int(good), int(toxic)))
    rows += [(n, None), (n + 1, ""), (n + 2, "word " * 200_000), (0, rows[0][1]), (None, "a b c")]
    return rows, labels


def frames(spark, rows, labels):
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'x' as score", "1 as predicted")
    return docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def held(doc_id, mod, rest):
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % mod == rest


def check(spark, score, column, mod, rest, at):
    rows, labels = corpus(900)
    docs, marks = frames(spark, rows, labels)
    got = score(docs, marks).collect()
    assert len(got) == len(rows)
    assert all(r.held_out == held(r.doc_id, mod, rest) for r in got)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got)
    truth = {x[0]: x[at] for x in labels}
    apart = [(r.predicted, truth[r.doc_id]) for r in got if r.held_out and r.doc_id in truth]
    assert np.mean([a == b for a, b in apart]) > 0.95
    first = {r.doc_id: r.score for r in got}
    flipped = [(i, *(1 - v if held(i, mod, rest) else v for v in x)) for i, *x in labels]
    again = {r.doc_id: r.score for r in score(docs, frames(spark, rows, flipped)[1]).collect()}
    assert first == again


def test_toxicity_on_held_out_rows(spark):
    check(spark, toxicity.score_toxicity, "toxic", 4, 2, 2)


def test_quality_on_held_out_rows(spark):
    check(spark, quality.score_quality, "quality", 5, 0, 1)


def test_empty_and_unlabelled(spark):
    docs, labels = frames(spark, [(1, "a b"), (2, None)], [])
    none = spark.createDataFrame([], "doc_id long, text string")
    for f in (toxicity.score_toxicity, quality.score_quality):
        assert f(none, labels).collect() == []
        assert len(f(docs, labels).collect()) == 2


def test_trees_find_an_interaction():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(4000, 5))
    y = ((x[:, 0] > 0) & (x[:, 3] < 0.5)).astype(float)
    t = Trees().fit(x[:3000], y[:3000])
    assert ((t.score(x[3000:]) > 0) == (y[3000:] > 0)).mean() > 0.98


def test_isotonic_is_monotone_and_least_squares():
    rng = np.random.default_rng(1)
    s = rng.normal(size=500)
    y = (rng.random(500) < 1 / (1 + np.exp(-2 * s))).astype(float)
    at, value = isotonic(s, y)
    assert (np.diff(at) > 0).all() and (np.diff(value) >= 0).all()
    assert abs(np.interp(s, at, value).mean() - y.mean()) < 0.05


def test_prior_and_non_negative_risk():
    rng = np.random.default_rng(2)
    pos = rng.normal(2, 1, (1500, 3))
    mixed = np.concatenate([rng.normal(2, 1, (1050, 3)), rng.normal(-2, 1, (450, 3))])
    rng.shuffle(mixed)
    assert abs(quality.estimate_prior(pos, mixed) - 0.7) < 0.1
    model = quality.fit(pos, mixed)
    out = model["net"].out(np.clip((np.array([[2, 2, 2], [-2, -2, -2]]) - model["middle"]) / model["spread"], -6, 6))
    assert out[0] > 0 > out[1]


def test_scores_do_not_depend_on_block_borders():
    rows, _ = corpus(50)
    texts = pa.array([t for _, t in rows])
    from fragmill.llm import _features as X

    whole = X.style(X.Words(texts))
    parts = np.concatenate([X.style(X.Words(texts.slice(i, 7))) for i in range(0, len(texts), 7)])
    assert np.allclose(whole, parts)
