"""Benchmark decontamination by template canonicalisation.

Words lose case and outer punctuation; numbers, units and (in a second reading) capitalised names become
typed placeholders, of which the values are kept as slots. Windows of the resulting template are hash-joined
between documents and benchmark items. A re-parameterised question shares the template with other values, so
matches count only as far as their slots are consistent: along one alignment, equal values of the item must
stand for equal values of the document. An alignment is one row's matches at one shift between the places of
the item and of the text, or at shifts within a band of 2 * BAND words (words put in or left out move it). An
item is leaked where one alignment has enough of its windows and is consistent.

Windows of few literal words are no templates. An item that has such windows, or is under ``LEAST_WORDS``, is
also looked for in a third reading, in which values and signs standing alone are words like any other; an item
shorter than a window is one window, so that verbatim copies of any item are found.

The benchmark's windows are broadcast only while their number is under ``most_windows``; beyond, all windows
of the documents are shuffled to the join.

Defined results: null or empty texts and items match nothing; templates need ``LEAST_LITERALS`` literal words a
window; each row is judged by its own text (known by 64 bits) and an id is reported once for an item, with its
best row; a row without doc_id can be reported with a null id.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fragmill.llm import _features as X
from fragmill.llm import _text as T
from fragmill.llm._tables import unused, written

WIDTH, LEAST_WORDS, LEAST_LITERALS = 8, 4, 3
LEAST_COVER, LEAST_CONSISTENT = 0.5, 0.75
MOST_WINDOWS, MOST_LEAKED = 2_000_000, 1_000_000
BAND = 8
LITERAL = 2  # the reading in which words stand as they are
UNITS = "mm cm m km inch inches ft feet mile miles yard yards g kg mg lb lbs oz ton tons ml l litre litres liter liters gallon gallons s sec second seconds min minute minutes h hour hours day days week weeks month months year years % percent $ € £ dollar dollars euro euros pound pounds cent cents mph kmh degrees °c °f kb mb gb".split()
NUMBERS = "zero one two three four five six seven eight nine ten eleven twelve twenty thirty forty fifty hundred thousand million".split()
NUMBER, UNIT, NAME = np.uint64(0x11), np.uint64(0x22), np.uint64(0x33)
WINDOW = "mode int, hash long, at int, slots array<string>, width int"


def _listed(words: list[str]) -> np.ndarray:
    return np.sort(X.Words(pa.array([" ".join(words)])).named(np.cumsum([len(w.encode()) + 1 for w in words]) - 1))


class Templates:
    """Template words of a block of texts in both readings, and all words as they are."""

    def __init__(self, column: pa.Array):
        self.data, self.off = T.flat(column)
        st, end, word_off = T.words(self.data, self.off)
        kind = X.KIND[self.data]
        outer = X.PUNCT & ~np.isin(np.arange(256), list(b"%$"))
        for _ in range(3):
            st = st + (outer[self.data[st]] & (st < end - 1) if len(st) else st)
            end = end - (outer[self.data[end - 1]] & (end - 1 > st) if len(st) else end)
        solid = ~((end - st == 1) & outer[self.data[st]]) if len(st) else np.zeros(0, bool)
        doc_of = np.repeat(np.arange(len(self.off) - 1), np.diff(word_off))
        doc = doc_of[solid]
        self.st, self.end = st[solid], end[solid]
        literal = T.word_hashes(self.data, st, end, lower=True)
        plain = literal[solid]
        digits = np.concatenate([[0], np.cumsum(kind == 2)])
        letters = np.concatenate([[0], np.cumsum((kind <= 1) | (kind == 5))])
        number = (digits[self.end] > digits[self.st]) & (letters[self.end] == letters[self.st])
        number |= X.member(_NUMBERS, plain) >= 0
        unit = X.member(_UNITS, plain) >= 0
        self.upper = kind[self.st] == 1 if len(self.st) else number
        typed = np.where(number, NUMBER, np.where(unit, UNIT, plain))
        self.readings = []
        every = np.arange(len(typed))
        self.readings.append((every, typed, number | unit, doc))
        name = self.upper & ~number & ~unit
        again = np.zeros(len(name), bool)
        again[1:] = name[1:] & name[:-1] & (doc[1:] == doc[:-1])  # a name of several words is one slot
        keep = np.flatnonzero(~again)
        self.readings.append((keep, np.where(name, NAME, typed)[keep], (number | unit | name)[keep], doc[keep]))
        self.readings.append((np.arange(len(literal)), literal, np.zeros(len(literal), bool), doc_of))

    def windows(self, mode: int, width: int):
        """(hash, place, document, words, slots) of a reading's windows with enough literal words, and whether
        windows have too few."""
        place, names, slot, doc = self.readings[mode]
        word_off = np.searchsorted(doc, np.arange(len(self.off)))
        hashes, at = T.windows(names, word_off, width)
        many = np.concatenate([[0], np.cumsum(slot)])
        ok = width - (many[at + width] - many[at]) >= min(LEAST_LITERALS, width)
        return hashes[ok] ^ np.uint64(mode), at[ok], doc, word_off, place, slot, not ok.all()

    def values(self, place: np.ndarray, slot: np.ndarray, at: int, width: int) -> list[str]:
        """Values of the placeholders in one window."""
        raw = self.data
        return [raw[self.st[p] : self.end[p]].tobytes().decode(errors="replace").lower() for p in place[at : at + width][slot[at : at + width]]]


_UNITS, _NUMBERS = _listed(UNITS), _listed(NUMBERS)


def _rows(t: Templates, ids: list, mode: int, width: int, known: np.ndarray | None):
    """Rows of the windows, and whether windows had too few literal words."""
    out: list[tuple] = []
    hashes, at, doc, word_off, place, slot, left = t.windows(mode, width)
    hit = np.arange(len(at)) if known is None else np.flatnonzero(X.member(known, hashes) >= 0)
    for h, a in zip(hashes[hit].view(np.int64).tolist(), at[hit].tolist()):
        d = doc[a]
        out.append((ids[d], mode, h, a - int(word_off[d]), t.values(place, slot, a, width), width))
    return out, left


SCHEMA = [("id", pa.int64()), ("mode", pa.int32()), ("hash", pa.int64()), ("at", pa.int32()), ("slots", pa.list_(pa.string())), ("width", pa.int32())]


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, (_, t) in enumerate(SCHEMA)], names=[n for n, _ in SCHEMA])


def _item_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(batch.num_rows):
            t = Templates(batch.column("text").slice(i, 1))
            ids, short = [batch.column("id")[i].as_py()], False
            for mode in (0, 1):
                n = len(t.readings[mode][0])
                rows, left = _rows(t, ids, mode, min(n, WIDTH), None) if n >= LEAST_WORDS else ([], True)
                short |= left
                if rows:
                    yield _batch(rows)
            n = len(t.readings[LITERAL][0])
            if short and n:
                yield _batch(_rows(t, ids, LITERAL, min(n, WIDTH), None)[0])


def _judged(docs: DataFrame, benchmark: DataFrame, most_windows: int) -> DataFrame:
    """key (of a text), item_id and figures of the best alignment as a struct b: the items found in texts."""
    docs = docs.select(_key(docs).alias("id"), F.col("text").cast("string").alias("text"))
    items = benchmark.select(F.col("item_id").cast("long").alias("id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    sought = written(items.mapInArrow(_item_windows, "id long, " + WINDOW))
    few = sought.count() <= most_windows
    known = None
    if few:
        got = sought.select("hash").distinct().toArrow().column("hash").to_numpy()
        known = np.sort(got.view(np.uint64))
    kinds = sorted((r[0], r[1]) for r in sought.select("mode", "width").distinct().collect())  # 24 at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in T.blocks(batches):
            t, ids = Templates(block.column("text")), block.column("id").to_pylist()
            for mode, width in kinds:
                rows, _ = _rows(t, ids, mode, width, known)
                if rows:
                    yield _batch(rows)

    sizes = sought.groupBy("id", "mode").agg(F.countDistinct("at").alias("n_windows"))
    right = sought.join(sizes, ["id", "mode"]).select(F.col("id").alias("item_id"), "mode", "hash", F.col("at").alias("place"), F.col("slots").alias("asked"), "n_windows")
    right = F.broadcast(right) if few else right
    met = docs.mapInArrow(run, "id long, " + WINDOW).drop("width").withColumnRenamed("id", "key").join(right, ["mode", "hash"])
    met = met.select("key", "item_id", "mode", (F.col("at") - F.col("place")).alias("shift"), "place", "n_windows", F.arrays_zip("asked", "slots").alias("pairs"))
    met = written(met)  # read twice below
    # an alignment is one shift (band 0) or one of two overlapping bands of shifts
    step = F.floor(F.col("shift") / BAND).cast("int")
    lines = F.array(*(F.struct(F.lit(kind).alias("band"), x.alias("line")) for kind, x in ((0, F.col("shift")), (1, step), (1, step - 1))))
    met = met.withColumn("l", F.explode(lines)).select("*", "l.band", "l.line")
    key = ["key", "item_id", "mode", "band", "line"]
    # one row for each place matched, then for each slot value: how many values of the document it stands for
    places = met.groupBy(*key, "n_windows", "place").agg(F.lit(1).alias("one"))
    cover = places.groupBy(*key).agg(F.first("n_windows").alias("n_windows"), F.count("one").alias("n_matched"))
    cover = cover.withColumn("coverage", F.col("n_matched") / F.col("n_windows")).where(F.col("coverage") >= LEAST_COVER)
    values = met.select(*key, F.explode("pairs").alias("pair")).groupBy(*key, "pair.asked").agg(F.countDistinct("pair.slots").alias("stands"))
    slots = values.groupBy(*key).agg(F.count("*").alias("n_slots"), F.count_if(F.col("stands") == 1).alias("n_consistent"))
    both = cover.join(slots, key, "left").fillna(0, ["n_slots", "n_consistent"])
    found = both.where(F.col("n_consistent") >= LEAST_CONSISTENT * F.col("n_slots"))
    return found.groupBy("key", "item_id").agg(F.max(F.struct("coverage", (-F.col("mode")).alias("m"), "n_windows", "n_matched", "n_slots", "n_consistent")).alias("b"))


def _key(docs: DataFrame):
    return F.xxhash64(docs["text"].cast("string"))


def leaks(docs: DataFrame, benchmark: DataFrame, most_windows: int = MOST_WINDOWS) -> DataFrame:
    """doc_id, item_id, n_windows, n_matched, coverage, n_slots, n_consistent: the items found in documents."""
    judged = _judged(docs, benchmark, most_windows)
    best = docs.select(F.col("doc_id").cast("long").alias("doc_id"), _key(docs).alias("key")).join(judged, "key")
    best = best.groupBy("doc_id", "item_id").agg(F.max("b").alias("b"))
    return best.select("doc_id", "item_id", "b.n_windows", "b.n_matched", "b.coverage", "b.n_slots", "b.n_consistent")


def without_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows in whose text no item is found, all columns. The texts found are broadcast while they are at most
    ``MOST_LEAKED`` hashes; beyond, rows are shuffled by the hash of their text."""
    name = unused(docs, "leaked")
    found = written(_judged(docs, benchmark, MOST_WINDOWS).select(F.col("key").alias(name)).distinct())
    if found.count() <= MOST_LEAKED:
        found = F.broadcast(found)
    return docs.join(found, _key(docs) == found[name], "left_anti")
