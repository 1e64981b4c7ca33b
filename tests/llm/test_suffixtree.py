import math
import random
import re
import tracemalloc
from collections import Counter
from types import SimpleNamespace

import numpy as np
import pyarrow as pa

from fragmill.llm import suffixtree
from fragmill.llm.suffixtree import LEAST_COUNT, LEAST_GAIN, STRENGTHS, held_out, score_texts

WORD = re.compile("[^\x20\x09-\x0d]+")


def brute(rows):
    docs = [(i, [*WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or "")), None]) for i, t in rows]
    train = [w for i, w in docs if not held_out(i)]
    n = [Counter(tuple(w[j - o : j + 1]) for w in train for j in range(o, len(w))) for o in range(3)]
    size, vocabulary = sum(n[0].values()), len(n[0])

    def root(w):
        return (n[0][(w,)] + 0.1) / (size + 0.1 * (vocabulary + 1))

    def nxt(gram, parent, m, less=0):
        c = n[len(gram) - 2][gram[:-1]]
        return (max(n[len(gram) - 1][gram] - less, 0) + m * parent) / (max(c - less, 0) + m)

    def loo_parent(gram):
        if len(gram) == 2 or gram[1:2] not in kept:
            return root(gram[-1])
        return nxt(gram[1:], root(gram[-1]), kept[gram[1:2]], 1)

    kept = {}
    for o in (1, 2):
        gains = {}
        for w in train:
            for j in range(o, len(w)):
                g = tuple(w[j - o : j + 1])
                if n[o - 1][g[:-1]] >= LEAST_COUNT:
                    p = loo_parent(g)
                    x = gains.setdefault(g[:-1], [0.0] * len(STRENGTHS))
                    for k, m in enumerate(STRENGTHS):
                        x[k] += math.log(nxt(g, p, m, 1) / p)
        kept |= {c: STRENGTHS[x.index(max(x))] for c, x in gains.items() if max(x) >= LEAST_GAIN}
    out = {}
    for i, w in docs:
        base = score = 0.0
        for j, t in enumerate(w):
            p = root(t)
            base += math.log10(p)
            for o in (1, 2):
                g = tuple(w[j - o : j + 1]) if j >= o else None
                if g and g[:-1] in kept:
                    p = nxt(g, p, kept[g[:-1]])
            score += math.log10(p)
        out[i] = (held_out(i), len(w), sum(n[0][(t,)] > 0 for t in w), size, round(base, 6), round(score, 4))
    return out, kept


def corpus():
    rnd = random.Random(6)
    vocab = [f"w{i}" for i in range(60)]
    phrases = [[rnd.choice(vocab) for _ in range(12)] for _ in range(5)]
    rows = []
    for i in range(120):
        w = [rnd.choice(vocab) for _ in range(rnd.randrange(0, 60))]
        if rnd.random() < 0.6:
            w += rnd.choice(phrases)
        rows.append((i, " ".join(w)))
    return rows + [(500, None), (501, ""), (502, "W1 w1 Unknown"), (503, "a b c " * 2000)]


def test_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(suffixtree, "CHUNK_BYTES", 3000)
    rows = corpus()
    want, kept = brute(rows)
    assert any(len(c) == 2 for c in kept) and any(len(c) == 1 for c in kept)
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as chunk", "2 as score")
    got = {r.doc_id: (r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6), round(r.score, 4)) for r in score_texts(df, longest=2, exact=True).collect()}
    assert got == want
    held = [i for i, _ in rows if held_out(i)]
    assert sum(want[i][5] for i in held) > sum(want[i][4] for i in held)


def test_states_are_distributions():
    # p(w | c) sums to one over the vocabulary and the unknown token
    n, size, vocabulary, m = {"a": 3, "b": 1}, 10, 4, 4.0
    counts = {"a": 3, "b": 1, "c": 4, "d": 2}
    root = {w: (counts[w] + 0.1) / (size + 0.1 * (vocabulary + 1)) for w in counts} | {"?": 0.1 / (size + 0.1 * (vocabulary + 1))}
    assert abs(sum(root.values()) - 1) < 1e-12
    assert abs(sum((n.get(w, 0) + m * p) / (4 + m) for w, p in root.items()) - 1) < 1e-12


def test_empty_and_untrained(spark):
    assert score_texts(spark.createDataFrame([], "doc_id long, text string")).collect() == []
    rows = score_texts(spark.createDataFrame([(None, "a b"), (None, "a b")], "doc_id long, text string")).collect()
    assert [(r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score) for r in rows] == [(True, 3, 0, 0, 0.0)] * 2


def test_messages_without_loss_change_little(spark, monkeypatch):
    """The default's units and widths against the exact setting, over contexts of any length."""
    monkeypatch.setattr(suffixtree, "CHUNK_BYTES", 3000)
    df = spark.createDataFrame(corpus(), "doc_id long, text string")
    cut, exact = ({r.doc_id: (r.score, r.base_score) for r in score_texts(df, exact=e).collect()} for e in (False, True))
    assert all(abs(cut[i][0] - exact[i][0]) <= 0.01 * abs(exact[i][0]) + 1e-9 and abs(cut[i][1] - exact[i][1]) < 1e-6 for i in exact)


def test_memory_of_a_chunk(monkeypatch):
    """Arrays of a chunk's tokens are held in a worker beside the executor's heap."""
    monkeypatch.setattr(suffixtree, "TaskContext", SimpleNamespace(get=lambda: SimpleNamespace(partitionId=lambda: 0)))
    rnd = random.Random(3)
    texts = [" ".join(f"w{int(rnd.paretovariate(0.6)) % 5000}" for _ in range(500)) for _ in range(300)]
    batch = pa.record_batch({"doc_id": pa.array(range(300), pa.int64()), "text": pa.array(texts)})
    (packed,) = suffixtree._chunked(iter([batch]))
    tracemalloc.start()
    chunk = suffixtree._Chunk(pa.Table.from_batches([packed]), 64, 10, 0)
    chunk.grow(np.full(len(chunk.tokens), LEAST_COUNT))
    held, _ = tracemalloc.get_traced_memory()
    tracemalloc.stop()
    assert len(chunk.tokens) == 300 * 501
    assert held < 60 * len(chunk.tokens)
