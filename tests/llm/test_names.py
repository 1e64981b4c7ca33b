"""Names of words, pieces and runs: unlike strings of regular spelling must not share one."""

import numpy as np
import public_tokenizers
import pyarrow as pa
from tokenizers import Tokenizer

from fragmill.llm import _exchange as X
from fragmill.llm import _text as T
from fragmill.llm.packing import encoder
from fragmill.llm.substring import remove_repeated_windows
from fragmill.llm.suffix import remove_repeated_bytes


def mirrored(a="a", b="b", n=1024):
    bits = [0]
    while len(bits) < n:
        bits += [1 - x for x in bits]
    return "".join((a, b)[x] for x in bits), "".join((b, a)[x] for x in bits)


def test_mirrored_words_keep_their_windows(spark):
    x, y = mirrored()
    rest = " ".join(f"w{i}" for i in range(34))
    rows = [(1, f"{x} {rest}"), (2, f"{y} {rest}"), (3, f"{mirrored(n=32)[0]} {rest}"), (4, f"{mirrored(n=32)[1]} {rest}")]
    got = remove_repeated_windows(spark.createDataFrame(rows, "doc_id long, text string"), 35).collect()
    assert [r.n_removed for r in got] == [0] * 4
    same = remove_repeated_windows(spark.createDataFrame(rows + [(5, rows[0][1])], "doc_id long, text string"), 35).collect()
    assert sorted((r.doc_id, r.n_removed) for r in same) == [(1, 35), (2, 0), (3, 0), (4, 0), (5, 35)]


def test_mirrored_bytes(spark):
    x, y = mirrored("a" * 450, "b" * 450, 64)
    strings = [[t[i : i + 400] for i in range(len(t) - 399)] for t in (x, y)]
    held = {}
    for s in sum(strings, []):
        held[s] = held.get(s, 0) + 1
    want = []
    for own in strings:
        gone = np.zeros(len(own) + 399, bool)
        for i, s in enumerate(own):
            if held[s] > 1:
                gone[i : i + 400] = True
        want.append(int(gone.sum()))
    got = remove_repeated_bytes(spark.createDataFrame([(1, x), (2, y)], "doc_id long, text string")).collect()
    assert [r.n_removed for r in sorted(got, key=lambda r: r.doc_id)] == want


def test_mirrored_pieces():
    path = str(public_tokenizers.path("byte_bpe_50k.json"))
    tok = Tokenizer.from_file(path)
    for text in mirrored() + mirrored(n=64):
        assert encoder(path).encode([text])[0].tolist() == tok.encode(text, add_special_tokens=False).ids


def test_names_follow_the_bytes():
    words = ["", "a", "ab", "abcdefg", "abcdefgh", "abcdefghi", "x" * 64, "x" * 65, "x" * 66, "é", "A", "\0", "\0\0"]
    data, off = T.flat(pa.array(words))
    names = T.span_names(data, off[:-1], off[1:])
    assert len(set(names.tolist())) == len(words)
    joined = "--" + "-".join(words)
    at = np.array([len(("--" + "-".join(words[:i]) + ("-" if i else "")).encode()) for i in range(len(words))])
    data, _ = T.flat(pa.array([joined]))
    size = np.array([len(w.encode()) for w in words])
    assert (T.span_names(data, at, at + size) == names).all()


def test_messages_round_trip():
    rng = np.random.default_rng(1)
    for low in (0, 20, 63):
        keys = np.unique(rng.integers(0, 2**63, 5000, dtype=np.uint64) >> np.uint64(low) << np.uint64(low))
        assert (X.unpack_keys(X.loosened(X.squeezed(X.pack_keys(keys)))) == keys).all()
    assert len(X.unpack_keys(X.pack_keys(np.zeros(0, np.uint64)))) == 0 and X.loosened(X.squeezed(b"")) == b""


def test_relays_change_no_result(spark, monkeypatch):
    """Beyond TOP_BITS messages go through relays; small sizes make all of them work on a small table."""
    import random

    from fragmill.llm import suffixtree

    rnd = random.Random(3)
    vocab = [f"w{i}" for i in range(80)]
    shared = " ".join(rnd.choice(vocab) for _ in range(140))
    rows = [(i, " ".join(rnd.choice(vocab) for _ in range(rnd.randrange(120))) + (" " + shared if i % 7 == 0 else "")) for i in range(150)]
    df = spark.createDataFrame(rows + rows[:3], "doc_id long, text string")
    monkeypatch.setattr(suffixtree, "CHUNK_BYTES", 4000)
    monkeypatch.setattr(X, "CHUNK_BYTES", 4000)

    def results():
        ops = (remove_repeated_windows(df, 10), remove_repeated_bytes(df, 64), suffixtree.score_texts(df))
        return [sorted(tuple(round(x, 6) if isinstance(x, float) else x for x in r) for r in op.collect()) for op in ops]

    want = results()
    monkeypatch.setattr(X, "BUCKET_KEYS", 200)
    several = results()
    monkeypatch.setattr(X, "TOP_BITS", 2)
    monkeypatch.setattr(X, "RELAY_KEYS", 700)
    assert X.bucket_bits(sum(len(t) for _, t in rows) // 8) > 2
    assert want == several == results()
