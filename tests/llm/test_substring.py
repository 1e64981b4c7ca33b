import hashlib
import random
import re
from collections import Counter

from fragmill.llm.substring import remove_repeated_windows

WORD = re.compile("[^\x20\x09-\x0d]+")


def brute(rows, k):
    docs = [(i, WORD.findall(t or "")) for i, t in rows]
    count = Counter(tuple(w[i : i + k]) for _, w in docs for i in range(len(w) - k + 1))
    out = []
    for d, w in docs:
        gone = set()
        for i in range(len(w) - k + 1):
            if count[tuple(w[i : i + k])] > 1:
                gone.update(range(i, i + k))
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((d, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=str)


def run(spark, rows, k):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    return sorted([tuple(r)[:4] for r in remove_repeated_windows(df, k).collect()], key=str)


def test_against_brute_force(spark):
    rnd = random.Random(3)
    vocab = ["a", "b", "ñé", "dd", "x y", "Z."]
    rows = [(i, rnd.choice([" ", "\n", "\t "]).join(rnd.choice(vocab) for _ in range(rnd.randrange(0, 60)))) for i in range(80)]
    rows += [(100, rows[3][1]), (101, None), (102, ""), (103, "  \n "), (104, "a " * 500), (7, rows[7][1]), (None, rows[5][1]), (None, rows[5][1])]
    assert run(spark, rows, 5) == brute(rows, 5)
    assert run(spark, rows, 35) == brute(rows, 35)


def test_empty_table_and_extra_columns(spark):
    df = spark.createDataFrame([], "doc_id long, text string, chunk int, bucket string")
    assert remove_repeated_windows(df).collect() == []
    df = spark.createDataFrame([(1, "a b c a b c", 5, "x")], "doc_id long, text string, chunk int, keys string")
    got = remove_repeated_windows(df, 3, with_text=True).collect()
    assert got[0].n_removed == 6 and got[0].kept == "" and [tuple(x) for x in got[0].spans] == [(0, 6)]


def test_very_long_text(spark):
    rnd = random.Random(5)
    words = [str(rnd.randrange(10**6)) for _ in range(400_000)]
    rows = [(1, " ".join(words)), (2, "q " + " ".join(words[1000:1100]) + " z")]
    got = {r[0]: r for r in run(spark, rows, 35)}
    assert got[1][1:3] == (400_000, 100) and got[2][1:3] == (102, 100)
