import random
import zlib
from itertools import groupby

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from fragmill.llm.packing import FORCED_CUT, PER_SEQUENCE, choose_cuts, encoder, pack

PATH = str(public_tokenizers.path("byte_bpe_50k.json"))


@pytest.fixture(scope="module")
def tok():
    return Tokenizer.from_file(PATH)


ODD = ["don't  stop\n\n now", "a  b", "  lead", "tail  ", "x\n y", "x \n", "\t\tq", "", " ", "\n", "1a2 b3!!? é ñ", "漢字 ok", "a b", "<|endoftext|> hi", "hello <|endoftext|> world", "a<|endoftext|>",  "a\r\nb", "ÿŸ ſ", "½ ² ª º", "a \x0b b", "x\x00y"]


def test_encoder_equals_the_tokenizer(tok):
    rnd = random.Random(1)
    texts = ODD + ["".join(rnd.choice("ab éñ12 .,!\n\t ") for _ in range(rnd.randrange(50))) for _ in range(500)]
    for _ in range(2):
        assert [x.tolist() for x in encoder(PATH).encode(texts)] == [x.ids for x in tok.encode_batch(texts, add_special_tokens=False)]


def test_cuts_are_optimal():
    rnd = random.Random(2)
    for _ in range(60):
        limit = 128
        places = np.unique([0, *(rnd.randrange(1, 900) for _ in range(60)), *range(100, 900, 100)])
        pen = np.array([rnd.choice([0, 2, FORCED_CUT]) for _ in places], float)
        cuts = choose_cuts(places, pen, limit)

        def price(n):
            return PER_SEQUENCE + (0 if n >= 64 and n & (n - 1) == 0 else limit - n)

        best = [0.0]
        for i in range(1, len(places)):
            best.append(min(best[j] + price(places[i] - places[j]) + pen[i] for j in range(i) if places[i] - places[j] <= limit))
        at = {p: i for i, p in enumerate(places.tolist())}
        got = sum(price(b - a) + pen[at[b]] for a, b in zip(cuts.tolist(), cuts.tolist()[1:]))
        assert got == best[-1]


def test_round_trip(spark, tok):
    rnd = random.Random(4)
    rows = [(i, t) for i, t in enumerate(ODD)] + [(100, None), (101, "word " * 9000), (102, "x" * 30000)]
    rows += [(200 + i, " ".join(rnd.choice(["alpha", "beta.", "Gamma!\n", "δ"]) for _ in range(rnd.randrange(400)))) for i in range(200)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = pack(df, with_ids=True).collect()
    want = {i: [*tok.encode(t or "", add_special_tokens=False).ids, 1] for i, t in rows}
    by_doc = {k: sorted(g, key=lambda r: r.start) for k, g in groupby(sorted(got, key=lambda r: r.doc_id), lambda r: r.doc_id)}
    assert {k: sum((r.ids for r in g), []) for k, g in by_doc.items()} == want
    for r in got:
        assert r.length == len(r.ids) > 0 and r.doc_tokens == len(want[r.doc_id])
        assert r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes())
    padding = total = 0
    for _, g in groupby(sorted(got, key=lambda r: (r.sequence_id, r.offset)), lambda r: r.sequence_id):
        at = 0
        for r in g:
            assert r.offset == at
            at += r.length
        assert at <= 2048
        total += at
        padding += 0 if at & (at - 1) == 0 else 2048 - at
    assert padding < 0.1 * total + 3 * 2048


def test_empty_table(spark):
    assert pack(spark.createDataFrame([], "doc_id long, text string, start int")).collect() == []
