import random

from fragmill.llm.decontaminate import leaks, without_leaks
from tests.llm.test_decontaminate import ITEM, MORE, found, prose

SUM = "What is 23 + 45 - 12 * 8 + 9 - 4?"


def test_one_alignment_decides(spark):
    rnd = random.Random(3)
    item = "Anna pays 5 coins to the old baker in town and 6 coins to the young miller at the mill near the river"
    others = [item.replace("5", str(10 + i)).replace("6", str(40 + i)).split() for i in range(6)]
    # verbatim, and template matches with one value standing for two at other shifts
    bad = [" ".join(w[:10] + others[(i + 1) % 6][10:]).replace("Anna", f"Berta {i}") for i, w in enumerate(others)]
    rows = [(1, " ".join([item, *(prose(rnd, 30) + " " + b for b in bad)]))]
    # windows of the item far from each other
    words = MORE.split()
    rows.append((2, " ".join(prose(rnd, 60) + " " + " ".join(words[i : i + 8]) for i in range(0, 15))))
    # one word put in
    rows.append((3, " ".join(words[:11] + ["very"] + words[11:])))
    assert found(spark, rows, [(1, item), (2, MORE)]) == {(1, 1), (3, 2)}


def test_rows_are_judged_by_their_own_text(spark):
    rows = [(None, ITEM), (None, "a clean text"), (7, "so " + MORE), (7, "another clean text")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    items = spark.createDataFrame([(1, ITEM), (2, MORE)], "item_id long, text string")
    assert sorted(r.text for r in without_leaks(docs, items).collect()) == ["a clean text", "another clean text"]
    assert {(r.doc_id, r.item_id) for r in leaks(docs, items).collect()} == {(None, 1), (7, 2)}


def test_few_literals_and_short_items(spark):
    rows = [(1, "Now: " + SUM + " Think."), (2, SUM.replace("23", "24")), (3, "say Quick fox, now"), (4, "quick brown fox")]
    items = [(1, SUM), (2, "quick fox")]
    assert found(spark, rows, items) == {(1, 1), (2, 1), (3, 2)}  # of row 2 three of six windows
    assert found(spark, rows, items, most_windows=0) == found(spark, rows, items)
