import random
import re

import pytest

from fragmill.llm import minhash
from fragmill.llm.minhash import near_duplicates, without_near_duplicates

WORD = re.compile("[^\x20\x09-\x0d]+")


def shingles(t):
    w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def brute(rows, percent=85):
    sets = [(i, shingles(t)) for i, t in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, (_, a) in enumerate(sets):
        for j, (_, b) in enumerate(sets[:i]):
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                parent[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(sets):
        least[find(i)] = min(d, least.get(find(i), d))
    return sorted((d, len(s), least[find(i)], d == least[find(i)]) for i, (d, s) in enumerate(sets))


def edited(rnd, words, n):
    w = list(words)
    for _ in range(n):
        i = rnd.randrange(len(w))
        kind = rnd.randrange(3)
        if kind == 0:
            w[i] = rnd.choice(words) + "x"
        elif kind == 1:
            del w[i]
        else:
            w.insert(i, rnd.choice(words))
    return " ".join(w)


@pytest.mark.parametrize("block", [512, 16])
def test_against_brute_force(spark, block, monkeypatch):
    monkeypatch.setattr(minhash, "BLOCK", block)
    rnd = random.Random(block)
    vocab = [f"w{i}" for i in range(300)]
    rows = []
    for size, copies in ((60, 120), (150, 160), (400, 40), (30, 30)):
        base = [rnd.choice(vocab) for _ in range(size)]
        rows += [edited(rnd, base, rnd.randrange(0, 6)) for _ in range(copies)]
    rows += [" ".join(rnd.choice(vocab) for _ in range(rnd.randrange(0, 30))) for _ in range(60)]
    rows += [rows[3], rows[200], rows[200].upper(), "a b", "A\tB", "a", "", None, "  ", "a b c d e", "a b c d e f"]
    rnd.shuffle(rows)
    rows = [(i * 3 + 1, t) for i, t in enumerate(rows)]
    got = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(tuple(r) for r in got.collect()) == brute(rows)


def test_edge_tables(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, rep long, component int")
    assert near_duplicates(empty).collect() == []
    df = spark.createDataFrame([(None, "a b c"), (4, "a b c"), (4, "a b c"), (2, "A b  c"), (9, None)], "doc_id long, text string")
    got = sorted((tuple(r) for r in near_duplicates(df).collect()), key=str)
    assert got == sorted([(None, 1, None, True), (4, 1, 2, False), (4, 1, 2, False), (2, 1, 2, True), (9, 0, 9, True)], key=str)


def test_ids_that_name_several_texts(spark):
    rnd = random.Random(9)
    a, b = ([f"{x}{rnd.randrange(10**6)}" for _ in range(100)] for x in "ab")
    near = lambda w: " ".join([*w[:50], "other", *w[51:]])
    rows = [(9, " ".join(a)), (9, " ".join(b)), (3, near(a)), (4, near(b)), (9, " ".join(a)), (5, "alone"), (5, "apart")]
    got = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 80, with_class=True).collect()
    assert sorted((r.doc_id, r.component_id) for r in got) == [(3, 3), (4, 4), (5, 5), (5, 5), (9, 3), (9, 3), (9, 4)]
    left = without_near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(map(tuple, left.collect())) == sorted([(3, near(a)), (4, near(b)), (5, "alone"), (5, "apart")])


def test_columns_of_any_name_and_repeated_rows(spark):
    rows = [(1, "a b c d e f", 7, 8, 9, "x"), (1, "a b c d e f", 7, 8, 9, "x"), (2, "A b c d e f", 1, 1, 1, "y"), (3, None, 0, 0, 0, "z"), (None, "a", 1, 2, 3, "n"), (None, "a", 1, 2, 3, "n")]
    df = spark.createDataFrame(rows, "doc_id long, text string, kept_id int, class int, copies int, Text_Hash string")
    got = without_near_duplicates(df)
    assert got.columns == df.columns
    assert sorted((r.doc_id or 0, r.copies) for r in got.collect()) == [(0, 3), (1, 9), (3, 0)]


def test_large_groups_meet_by_prefixes(spark, monkeypatch):
    """Pages of common boilerplate share sub-keys without being alike; those that are alike link all the same."""
    monkeypatch.setattr(minhash, "BLOCK", 32)
    rnd = random.Random(12)
    common = [f"c{i}" for i in range(120)]
    rows = []
    for i in range(300):
        own = [f"u{rnd.randrange(10**9)}" for _ in range(40)]
        rows.append(" ".join(common + own))
        if i % 10 == 0:
            rows += [" ".join(common + own[:j] + ["z"] + own[j + 1 :]) for j in (5, 20)]
    rows = [(i, t) for i, t in enumerate(rows)]
    got = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 85)
    assert sorted(tuple(r) for r in got.collect()) == brute(rows)
