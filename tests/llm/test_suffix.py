import hashlib
import random
from collections import Counter

import pytest

from fragmill.llm.suffix import remove_repeated_bytes


def brute(rows, k):
    docs = [(i, (t or "").encode()) for i, t in rows]
    count = Counter(b[i : i + k] for _, b in docs for i in range(len(b) - k + 1))
    out = []
    for d, b in docs:
        gone = bytearray(len(b))
        for i in range(len(b) - k + 1):
            if count[b[i : i + k]] > 1:
                gone[i : i + k] = b"\1" * k
        runs = sum(gone[i] and not (i and gone[i - 1]) for i in range(len(b)))
        out.append((d, len(b), sum(gone), runs, hashlib.sha256(bytes(x for x, g in zip(b, gone) if not g)).hexdigest(), sum(gone) / max(len(b), 1)))
    return sorted(out, key=str)


def texts(rnd, n, size):
    shared = ["".join(rnd.choice("abcdé \n") for _ in range(size)) for _ in range(4)]
    out = []
    for i in range(n):
        t = "".join(rnd.choice("abcdefé ") for _ in range(rnd.randrange(0, size)))
        for _ in range(rnd.randrange(0, 4)):
            s = rnd.choice(shared)
            a = rnd.randrange(0, size // 2)
            t += s[a : a + rnd.randrange(size // 4, size)] + rnd.choice(["", "x", "yy"])
        out.append((i, t))
    return out


@pytest.mark.parametrize("k", [40, 400])
def test_against_brute_force(spark, k):
    rnd = random.Random(k)
    rows = texts(rnd, 40, 4 * k)
    rows += [(100, rows[3][1]), (101, None), (102, ""), (103, "a" * (3 * k)), (104, "ab" * k), (5, rows[5][1]), (None, "q" * (k - 1)), (None, "r" + "ab" * k)]
    rows += [(200 + i, f"{i:09d}" * 7 + rows[8][1][: 2 * k] + f"{i * 7919:09d}" * 6) for i in range(30)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted([tuple(r) for r in remove_repeated_bytes(df, k).collect()], key=str)
    assert got == brute(rows, k)


def test_empty_table_and_texts_out(spark):
    assert remove_repeated_bytes(spark.createDataFrame([], "doc_id long, text string, run int")).collect() == []
    df = spark.createDataFrame([(1, "x" + "abcdefgh" * 5 + "y", 1), (2, "abcdefgh" * 5, 2)], "doc_id long, text string, bucket int")
    got = {r.doc_id: r for r in remove_repeated_bytes(df, 40, with_text=True).collect()}
    assert bytes(got[1].kept) == b"xy" and bytes(got[2].kept) == b"" and [tuple(s) for s in got[1].spans] == [(1, 41)]
