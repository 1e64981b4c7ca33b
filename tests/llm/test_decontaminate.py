import random

from fragmill.llm import decontaminate
from fragmill.llm.decontaminate import leaks, without_leaks

ITEM = "A train leaves Boston at 9 and travels 60 miles per hour for 3 hours; how far does the train go before it stops near Boston again?"
MORE = "She buys five red apples and seven green pears from the old market and gives two apples to her brother before lunch."


def prose(rnd, n):
    return " ".join(rnd.choice(["the", "of", "and", "river", "stone", "walks", "under", "bright", "Sky", "never", "told", "us"]) + rnd.choice(["", ",", "."]) for _ in range(n))


def found(spark, rows, items, **kw):
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as item_id", "'x' as mode")
    bench = spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "7 as doc_id")
    return {(r.doc_id, r.item_id) for r in leaks(docs, bench, **kw).collect()}


def test_verbatim_changed_and_clean(spark):
    rnd = random.Random(9)
    other = ITEM.replace("Boston", "Dallas").replace("60", "75").replace("9", "11")
    rows = [
        (1, prose(rnd, 50) + " " + ITEM + " " + prose(rnd, 50)),
        (2, prose(rnd, 50) + "\n" + other + " " + prose(rnd, 5000)),
        (3, ITEM.lower()),
        (4, " ".join(MORE.split()[:16])),
        (5, " ".join(MORE.split()[:8])),
        (6, prose(rnd, 3000)),
        (7, None),
        (8, ""),
        (9, MORE.upper()),
        (1, prose(rnd, 50) + " " + ITEM),
    ]
    items = [(10, ITEM), (11, MORE), (12, None), (13, ""), (14, "one two"), (10, ITEM)]
    want = {(1, 10), (2, 10), (3, 10), (4, 11), (9, 11)}
    got = found(spark, rows, items)
    assert got == want
    assert found(spark, rows, items, most_windows=0) == want
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    left = without_leaks(docs, spark.createDataFrame(items, "item_id long, text string"))
    assert sorted(r.doc_id for r in left.collect()) == [5, 6, 7, 8]


def test_slots_must_be_consistent(spark):
    item = "Anna pays 5 coins and 5 coins and 5 coins and 5 coins and then 5 coins to the old baker in town"
    same = item.replace("5", "9")
    mixed = "Anna pays 5 coins and 6 coins and 7 coins and 8 coins and then 9 coins to the old baker in town"
    mixed = mixed.replace("Anna", "Berta").replace("baker", "miller")
    got = found(spark, [(1, same), (2, mixed)], [(1, item)])
    assert (1, 1) in got and (2, 1) not in got


def test_short_items_and_empty_tables(spark):
    assert found(spark, [(1, "well the quick brown fox jumps high"), (2, "the quick fox")], [(5, "The quick brown fox jumps")]) == {(1, 5)}
    assert found(spark, [], [(5, "a b c d e f g h i j")]) == set()
    assert found(spark, [(1, "a b c d e f g h i j")], []) == set()
    assert decontaminate.LEAST_WORDS == 4


def test_rows_keep_columns_of_any_name(spark):
    docs = spark.createDataFrame([(1, "x " + MORE + " y", 5), (2, "nothing here", 6)], "doc_id long, text string, leaked int")
    left = without_leaks(docs, spark.createDataFrame([(1, MORE)], "item_id long, text string"))
    assert left.columns == docs.columns and [tuple(r) for r in left.collect()] == [(2, "nothing here", 6)]
