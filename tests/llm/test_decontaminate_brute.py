"""Leaks against a plain reading of the rules: every window of every item against every window of every text."""

import random
import re

from fragmill.llm.decontaminate import BAND, LEAST_CONSISTENT, LEAST_COVER, LEAST_LITERALS, LEAST_WORDS, NUMBERS, UNITS, WIDTH, leaks

OUTER = set("".join(chr(i) for i in range(128) if not chr(i).isalnum() and i > 32) + "".join(map(chr, range(1, 9))) + "\x7f") - set("%$")


def readings(text):
    """(names, values, is a slot) of the three readings."""
    words = re.findall("[^\x20\x09-\x0d]+", text or "")
    literal = []
    for w in words:
        for _ in range(3):
            w = w[1:] if len(w) > 1 and w[0] in OUTER else w
            w = w[:-1] if len(w) > 1 and w[-1] in OUTER else w
        literal.append(w)
    kept = [w for w in literal if not (len(w) == 1 and w in OUTER)]
    typed = []
    for w in kept:
        low = w.lower()
        number = (any(c.isdigit() for c in w) and not any(c.isalpha() for c in w)) or low in NUMBERS
        kind = "#" if number else "~" if low in UNITS else "@" if w[0].isupper() else ""
        typed.append((low, kind))
    one = [(k if k in ("#", "~") else w, w, k in ("#", "~")) for w, k in typed if True]
    two = [(k or w, w, bool(k)) for i, (w, k) in enumerate(typed) if not (k == "@" and i and typed[i - 1][1] == "@")]
    return [one, two, [(w.lower(), w.lower(), False) for w in literal]]


def windows(reading, width):
    for at in range(len(reading) - width + 1):
        part = reading[at : at + width]
        if sum(not s for _, _, s in part) >= min(LEAST_LITERALS, width):
            yield at, tuple(n for n, _, _ in part), [v for _, v, s in part if s]


def brute(docs, items):
    sought = {}
    for item, text in items:
        r, short = readings(text), False
        for mode in (0, 1):
            n = len(r[mode])
            w = min(n, WIDTH)
            got = list(windows(r[mode], w)) if n >= LEAST_WORDS else []
            short |= n < LEAST_WORDS or len(got) < n - w + 1
            sought[item, mode] = (w, got)
        n = len(r[2])
        sought[item, 2] = (min(n, WIDTH), list(windows(r[2], min(n, WIDTH))) if short and n else [])
    out = {}
    for doc, text in docs:
        r = readings(text)
        for (item, mode), (width, asked) in sought.items():
            lines = {}
            have = list(windows(r[mode], width)) if asked else []
            for place, names, values in asked:
                for at, names2, values2 in have:
                    if names == names2:
                        shift = at - place
                        for line in ((0, shift), (1, shift // BAND), (1, shift // BAND - 1)):
                            places, stands = lines.setdefault(line, (set(), {}))
                            places.add(place)
                            for a, b in zip(values, values2):
                                stands.setdefault(a, set()).add(b)
            total = len({a for a, _, _ in asked})
            for places, stands in lines.values():
                consistent = sum(len(x) == 1 for x in stands.values())
                if len(places) / total >= LEAST_COVER and consistent >= LEAST_CONSISTENT * len(stands):
                    found = (len(places) / total, -mode, total, len(places), len(stands), consistent)
                    out[doc, item] = max(found, out.get((doc, item), found))
    return out


def test_against_brute_force(spark):
    rnd = random.Random(21)
    common = "the of and river stone walks under bright never told us train takes buys apples from to how many left after gives".split()
    names, units = ["Boston", "Ann", "Mary Lee", "Rome"], ["km", "hours", "kg", "%"]

    def sentence(n):
        out = []
        for _ in range(n):
            x = rnd.random()
            out.append(str(rnd.randrange(1, 60)) if x < 0.12 else rnd.choice(units) if x < 0.18 else rnd.choice(names) if x < 0.28 else "+" if x < 0.3 else rnd.choice(common) + rnd.choice(["", "", ",", "."]))
        return out

    def changed(words, keep):
        swap = {}
        return [w if rnd.random() < keep else swap.setdefault(w, str(rnd.randrange(100, 999))) if w.isdigit() else w for w in words]

    items = [sentence(n) for n in (1, 2, 3, 5, 8, 9, 12, 20, 30, 40) for _ in range(3)]
    docs = []
    for i in range(160):
        text = sentence(rnd.randrange(0, 60))
        for _ in range(rnd.randrange(0, 3)):
            own = changed(rnd.choice(items), rnd.choice([1, 0, 0.5]))
            if rnd.random() < 0.4 and own:
                own.insert(rnd.randrange(len(own)), "well")
            if rnd.random() < 0.3:
                own = own[: len(own) * 2 // 3]
            text = text + own + sentence(rnd.randrange(0, 9))
        docs.append((i, " ".join(text)))
    docs += [(900, None), (901, ""), (902, "+ + +")]
    items = [(i, " ".join(w)) for i, w in enumerate(items)] + [(800, None), (801, ""), (802, "What is 23 + 45 - 12 * 8 + 9 - 4?")]
    docs.append((903, "so what IS 23 + 45 - 12 * 8 + 9 - 4? yes"))
    want = brute(docs, items)
    assert len(want) > 60 and (903, 802) in want
    got = leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {(r.doc_id, r.item_id): (r.coverage, r.n_windows, r.n_matched, r.n_slots, r.n_consistent) for r in got} == {k: (v[0], *v[2:]) for k, v in want.items()}
    shuffled = leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), most_windows=0)
    assert sorted(map(tuple, shuffled.collect())) == sorted(map(tuple, got))
