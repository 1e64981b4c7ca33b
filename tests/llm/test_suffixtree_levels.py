import math
import random
from collections import Counter
from types import SimpleNamespace

import numpy as np
import pyarrow as pa

from fragmill.llm import _exchange as X
from fragmill.llm import suffixtree
from fragmill.llm.suffixtree import LEAST_COUNT, LEAST_GAIN, held_out, score_texts

STRENGTHS = (0.5, 4.0, 32.0)


def brute(rows):
    """Scores and kept contexts; one and two words as in test_suffixtree, longer ones below kept parents."""
    docs = [(i, [*t.split(), None]) for i, t in rows]
    train = [w for i, w in docs if not held_out(i)]
    most = max(len(w) for w in train)
    n = Counter(tuple(w[j - o : j + 1]) for w in train for j in range(len(w)) for o in range(min(j, 11) + 1))
    size, vocabulary = sum(c for g, c in n.items() if len(g) == 1), sum(len(g) == 1 for g in n)

    def root(w):
        return (n[(w,)] + 0.1) / (size + 0.1 * (vocabulary + 1))

    def nxt(g, parent, m, less):
        return (max(n[g] - less, 0) + m * parent) / (max(n[g[:-1]] - less, 0) + m)

    kept = {}

    def chain(g, less):
        p = root(g[-1])
        for o in range(2, len(g) + 1):
            if g[-o:-1] in kept:
                p = nxt(g[-o:], p, kept[g[-o:-1]], less)
            elif o > 3:
                break
        return p

    def level(o, parent, tried):
        gains = {}
        for g, held in n.items():
            if len(g) == o + 1 and n[g[:-1]] >= LEAST_COUNT and tried(g[:-1]):
                p = parent(g)
                x = gains.setdefault(g[:-1], [0.0] * 3)
                for k, m in enumerate(STRENGTHS):
                    x[k] += held * math.log(nxt(g, p, m, 1) / p)
        return {c: STRENGTHS[x.index(max(x))] for c, x in gains.items() if max(x) >= LEAST_GAIN}

    kept |= level(1, lambda g: root(g[-1]), lambda c: True)
    two = level(2, lambda g: chain(g[1:], 1), lambda c: True)
    kept |= two
    o, last = 3, two
    while last and o < min(most, 11):
        before = set(last)
        last = level(o, lambda g: chain(g[1:], 1), lambda c: c[1:] in before)
        kept |= last
        o += 1
    return {i: round(sum(math.log10(chain(tuple(w[max(0, j - 10) : j + 1]), 0)) for j in range(len(w))), 4) for i, w in docs}, kept


def test_contexts_of_any_length(spark, monkeypatch):
    monkeypatch.setattr(suffixtree, "CHUNK_BYTES", 3000)
    rnd = random.Random(11)
    after = {}  # the next word depends on the last four
    rows = []
    for i in range(150):
        w = [rnd.choice("abc") for _ in range(4)]
        for _ in range(rnd.randrange(5, 50)):
            w.append(rnd.choice("abc") if rnd.random() < 0.1 else after.setdefault(tuple(w[-4:]), rnd.choice("abbccc")))
        rows.append((i, " ".join(w)))
    want, kept = brute(rows)
    assert any(len(c) > 3 for c in kept)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: round(r.score, 4) for r in score_texts(df, longest=None, exact=True).collect()}
    assert got == want


def test_rare_words_end_contexts(spark):
    assert suffixtree.STRENGTHS == STRENGTHS
    pairs = [(i, "u x p" if i % 2 else "v x q") for i in range(14)]  # x occurs under 16 times
    scores = {r.doc_id: (r.score, r.base_score) for r in score_texts(spark.createDataFrame(pairs, "doc_id long, text string"), longest=2, exact=True).collect()}
    _, kept = brute(pairs)
    assert ("u", "x") in kept and ("v", "x") in kept
    want, _ = brute(pairs)
    assert {i: round(s, 4) for i, (s, _) in scores.items()} == want


def test_ids_are_hashed_once(monkeypatch):
    """The steps after the first read which texts are held out from the chunk."""
    ids = [3, None, 10, 3, 77]
    batch = pa.RecordBatch.from_pydict({"doc_id": pa.array(ids, pa.int64()), "text": ["A b", None, "b a  b", "", "c"]})
    monkeypatch.setattr(suffixtree, "TaskContext", SimpleNamespace(get=lambda: SimpleNamespace(partitionId=lambda: 0)))
    (packed,) = suffixtree._chunked(iter([batch]))
    want = {mod: [held_out(i, mod, 1) for i in ids] for mod in (2, 3)}

    def none(*_):
        raise AssertionError("hashed again")

    monkeypatch.setattr(suffixtree.zlib, "crc32", none)
    for mod, held in want.items():
        chunk = suffixtree._Chunk(pa.Table.from_batches([packed]), 40, mod, 1)
        assert chunk.held.tolist() == held and chunk.ids.to_pylist() == ids
        assert chunk.train.tolist() == [not held[d] for d in (0, 0, 0, 1, 2, 2, 2, 2, 3, 4, 4)]
        assert chunk.place.tolist() == [0, 1, 2, 0, 0, 1, 2, 3, 0, 0, 1]
        assert [i for i, t in enumerate(chunk.tokens) if t == suffixtree.END] == [2, 3, 7, 8, 10]
        assert chunk.tokens[0] == chunk.tokens[5] and chunk.tokens[1] == chunk.tokens[4] == chunk.tokens[6] != chunk.tokens[0]


def test_distinct_names_short_and_alike():
    rnd = np.random.default_rng(1)
    for n in (1, 2, 3, 1000, 70000):
        few = rnd.integers(0, 2**63, max(1, n // 3), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        for names in (few, few >> np.uint64(24) << np.uint64(24), few & np.uint64(0xFFFF), np.zeros(1, np.uint64)):
            keys = names[rnd.integers(0, len(names), n)]
            was = keys.copy()
            got, want = X.distinct(keys), np.unique(keys, return_counts=True, return_inverse=True)
            assert (keys == was).all() and (got[0] == want[0]).all() and (got[1] == want[2]).all() and (got[2] == want[1]).all()
            assert (keys[X.ranks(keys)] == np.sort(keys)).all()


def test_planes_of_all_widths():
    rnd = np.random.default_rng(2)
    for kind in (np.uint8, np.uint16, np.uint32, np.uint64):
        for n in (0, 1, 5, 1000):
            full = rnd.integers(0, np.iinfo(kind).max, n, dtype=kind, endpoint=True)
            for a in (full, full & kind(0x0F), full << kind(np.iinfo(kind).bits // 2), np.zeros(n, kind), full[::2]):
                raw = X.pack(a)
                want = a.copy().view(np.uint8).reshape(-1, a.itemsize)
                used = [i for i in range(a.itemsize) if want[:, i].any()]
                assert raw == bytes([sum(1 << i for i in used)]) + b"".join(want[:, i].tobytes() for i in used)
                back = X.unpack(raw, len(a), kind)
                assert back.dtype == kind and (back == a).all() and back.flags.writeable
