import hashlib
import random
import re

import numpy as np

from fragmill.llm import pii

RULES = {
    "email": re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    "ip": re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    "card": re.compile(r"[0-9]([\x20-]?[0-9])+"),
    "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
}


def ok(kind, s):
    digits = [int(c) for c in s if c.isdigit()]
    if kind == "ip":
        return all(int(x) <= 255 for x in s.split("."))
    if kind == "card":
        odd = digits[::-1]
        return 14 <= len(digits) <= 19 and sum(d if i % 2 == 0 else sum(divmod(2 * d, 10)) for i, d in enumerate(odd)) % 10 == 0
    return kind == "email" or 10 <= len(digits) <= 15


def brute(text):
    found = [(m.start(), list(RULES).index(k), m.end()) for k, r in RULES.items() for m in r.finditer(text) if ok(k, m[0])]
    return sorted(found)


def random_text(rnd):
    bits = ["a.b+c@x.y", "me@host", "@@", "x@-a..b", "q@a.b@c.d", "é@f.gh", "1.2.3.4", "300.1.1.1", "1.2.3.4.5", "0001.2.3.4", "4041894974608795", "4041 8949-7460 8795", "12345678901234", "+1 (988) 555-2485", "+49 30 1234567", "+1", "++12 34567890 1", "foo", " ", "\n", "..", "9", "-", "123456789", "a%b", "(at)", "x (at) y.com", "password=abc123def", "Dr. Jane Doe", "555-123-4567"]
    return "".join(rnd.choice(bits) + rnd.choice(["", " ", "\n"]) for _ in range(rnd.randrange(0, 30)))


def test_base_equals_the_rules(spark):
    rnd = random.Random(8)
    rows = [(i, random_text(rnd)) for i in range(1500)] + [(5000, None), (5001, ""), (5002, "1" * 4_000), (5003, "a" * 4_000 + "@b.c at x")]
    for _, t in rows:
        assert pii.base_spans(t or "") == brute(t or "")
    df = spark.createDataFrame(rows + rows[:3], "doc_id long, text string").selectExpr("*", "1 as spans")
    got = pii.find_pii(df, with_text=True).collect()
    assert len(got) == len(rows) + 3
    text = dict(rows)
    for r in got:
        base = brute(text[r.doc_id] or "")
        named = [f"{pii.KINDS[k]}:{a}:{b}" for a, k, b in base]
        assert r.base_sha256 == hashlib.sha256(",".join(named).encode()).hexdigest()
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == i for _, k, _ in base) for i in range(4)]
        every = r.spans.split(",") if r.spans else []
        assert set(named) <= set(every)
        assert every == sorted(every, key=lambda s: (int(s.split(":")[1]), pii.KINDS.index(s.split(":")[0])))
    assert [r.masked for r in got if r.doc_id == 5000] == [None]


def test_aggregation_recovers_reliabilities():
    rng = np.random.default_rng(3)
    truth = rng.random(20_000) < 0.4
    votes = np.zeros((20_000, pii.LABELERS), int)
    for i, right in enumerate((0.95, 0.9, 0.85, 0.8, 0.7, 0.6)):
        votes[:, i] = np.where(rng.random(20_000) < right, truth, ~truth) * 2 - 1
    pattern = (votes + 1) @ 3 ** np.arange(pii.LABELERS - 1, -1, -1)
    names, held = np.unique(pattern, return_counts=True)
    priors, ratio, q = pii.aggregate(np.zeros(len(names), int), names, held.astype(float))
    assert abs(priors[0] - 0.4) < 0.03
    assert (np.diff(ratio[:, 2]) < 0.1).all()
    best = dict(zip(names, q > 0.5))
    assert np.mean([best[p] == t for p, t in zip(pattern, truth)]) > 0.95


def test_very_long_runs_stay_linear():
    for text in ("1" * 300_000, "a" * 300_000 + "@b.c at", "1 " * 200_000, "+1" * 200_000, "a@" * 200_000, "1." * 200_000, "password=" * 40_000, "ab:" * 100_000):
        base = pii.base_spans(text)
        pii.candidates(text, base)


def test_mask_and_empty(spark):
    assert pii.mask("a b@c.de f", [(2, 0, 8)]) == "a <EMAIL> f"
    assert pii.find_pii(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_numbers_without_end(spark):
    rows = [(1, "1.2.3." + "0" * 5000 + "1"), (2, "1.2.3." + "9" * 6000), (3, "0" * 9000 + ".0.0.0"), (4, "١.2.3.4")]
    got = {r.doc_id: (r.n_ip, r.n_spans) for r in pii.find_pii(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: (1, 1), 2: (0, 0), 3: (1, 1), 4: (0, 0)}
