"""Toxicity: gradient-boosted trees over dense features, calibrated by isotonic regression.

Features: densities of a lexicon (words and word beginnings), its weight, nearness of its words to a second
person, capitals, punctuation, obfuscation and elongation rates, and the style of the text. The lexicon is
learnt from labelled texts as log-odds of toxic against clean. Training is cross-fitted: rows of one half
get features from the lexicon of the other half, so that the trees don't trust words that only fit their
own rows, and the calibration uses scores of trees that haven't seen the row. The model that scores has
the lexicon and the trees of all training rows.

The model is fitted on a bounded sample of labelled rows (``most_rows``); everything scored is a whole text.

Defined results: null counts as empty text and gets the score of an empty text; without labelled rows of
both classes every score is the share of toxic ones (0 without any); repeated rows get equal scores; several
labels of an id count as several rows; an id's label is used for every text of that id.
"""

from __future__ import annotations

import logging
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fragmill.llm import _features as X
from fragmill.llm import _text as T
from fragmill.llm._tables import written

MOST_ROWS = 24_000
HEADS = (4, 5, 6)
LEAST_TEXTS, LEAST_ODDS, MOST_ENTRIES, CELL_BITS = 3, 2.5, 100_000, 20
HALVES = ((0,), (1,), (0, 1))
THRESHOLD = 0.3


class Trees:
    """Gradient boosting of log-loss with shallow histogram trees."""

    def __init__(self, rounds: int = 60, depth: int = 3, rate: float = 0.2, bins: int = 48, least: int = 20):
        self.rounds, self.depth, self.rate, self.bins, self.least = rounds, depth, rate, bins, least

    def fit(self, x: np.ndarray, y: np.ndarray) -> Trees:
        marks = [np.unique(np.quantile(c, np.linspace(0, 1, self.bins + 1)[1:-1])) for c in x.T]
        self.marks = marks
        code = np.column_stack([np.searchsorted(m, c, "left") for m, c in zip(marks, x.T)])
        share = min(max(y.mean(), 1e-4), 1 - 1e-4)
        self.first = float(np.log(share / (1 - share)))
        score, self.trees, width = np.full(len(y), self.first), [], self.bins
        base, columns = np.arange(x.shape[1]) * width, x.shape[1] * width
        for _ in range(self.rounds):
            p = 1 / (1 + np.exp(-score))
            g, h = y - p, p * (1 - p) + 1e-9
            node, tree = np.zeros(len(y), np.int64), []
            for level in range(self.depth):
                count = 1 << level
                best, split = np.full(count, 1e-6), np.full((count, 2), [-1, 0])
                at = ((node * columns)[:, None] + base + code).reshape(-1)
                gs, hs, ns = (np.bincount(at, np.repeat(v, x.shape[1]), count * columns).reshape(count, x.shape[1], width).cumsum(axis=2) for v in (g, h, np.ones(len(y))))
                gt, ht, nt = gs[:, :, -1:], hs[:, :, -1:], ns[:, :, -1:]
                gain = gs**2 / (hs + 1) + (gt - gs) ** 2 / (ht - hs + 1) - gt**2 / (ht + 1)
                gain[(ns < self.least) | (nt - ns < self.least)] = 0
                gain = gain.reshape(count, -1)
                top = gain.argmax(axis=1)
                better = gain[np.arange(count), top] > best
                split[better] = np.column_stack([top // width, top % width])[better]
                feature, mark = split[node, 0], split[node, 1]
                right = (feature >= 0) & (code[np.arange(len(y)), np.maximum(feature, 0)] > mark)
                tree.append([(int(f), float(marks[f][b]) if 0 <= f and b < len(marks[f]) else np.inf) for f, b in split])
                node = node * 2 + right
            leaf = np.bincount(node, g, 1 << self.depth) / (np.bincount(node, h, 1 << self.depth) + 1) * self.rate
            score = score + leaf[node]
            self.trees.append((tree, leaf))
        return self

    def score(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.first)
        for tree, leaf in self.trees:
            node = np.zeros(len(x), np.int64)
            for level in tree:
                feature = np.array([max(f, 0) for f, _ in level])[node]
                mark = np.array([m if f >= 0 else np.inf for f, m in level])[node]
                node = node * 2 + (x[np.arange(len(x)), feature] > mark)
            out += leaf[node]
        return out


def isotonic(score: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Pool-adjacent-violators of weighted rows, with a small prior of each class; steps (score, value)."""
    order = np.argsort(score, kind="stable")
    weight = np.ones(len(score)) if weight is None else weight
    blocks: list[list[float]] = []
    for s, v, w in zip(score[order].tolist(), (y * weight)[order].tolist(), weight[order].tolist()):
        blocks.append([s, v, w])
        while len(blocks) > 1 and blocks[-2][1] * blocks[-1][2] >= blocks[-1][1] * blocks[-2][2]:
            s2, v2, n2 = blocks.pop()
            blocks[-1] = [s2, blocks[-1][1] + v2, blocks[-1][2] + n2]
    return np.array([b[0] for b in blocks]), np.array([(b[1] + 0.02) / (b[2] + 0.04) for b in blocks])


def features(column: pa.Array, lexicon: dict) -> np.ndarray:
    w = X.Words(column)
    n = np.maximum(np.diff(w.word_off), 1)
    near = np.zeros(len(w.hash) + 1)
    person = X.member(lexicon["person"], w.hash) >= 0
    at = np.flatnonzero(person)
    np.add.at(near, np.maximum(at - X.NEARBY, w.word_off[w.doc[at]]), 1)
    np.add.at(near, np.minimum(at + X.NEARBY + 1, w.word_off[w.doc[at] + 1]), -1)
    near = np.cumsum(near)[:-1] > 0
    cols = [w.per_doc(where=person) / n]
    any_hit = np.zeros(len(w.hash), bool)
    for kind, keys in [("word", w.hash), *((f"head{k}", w.heads(k)) for k in HEADS)]:
        names, weight = lexicon[kind]
        place = X.member(names, keys)
        hit = place >= 0
        any_hit |= hit
        value = np.where(hit, weight[place] if len(weight) else 0.0, 0.0)
        most = np.zeros(len(n))
        np.maximum.at(most, w.doc, value)
        cols += [w.per_doc(where=hit) / n, np.log1p(w.per_doc(where=hit)), np.log1p(w.per_doc(value)), most]
    cols += [w.per_doc(where=any_hit & near) / n, np.log1p(w.per_doc(where=any_hit))]
    return np.column_stack([*cols, X.style(w)])


def _cell(kind: int, keys: np.ndarray) -> np.ndarray:
    return (T.mix(keys + np.uint64(kind)) >> np.uint64(64 - CELL_BITS)).astype(np.int64)


def _cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        kind, key = batch.column("kind").to_numpy(), batch.column("key").to_numpy().view(np.uint64)
        own = [_cell(k, key[kind == k]) for k in range(1 + len(HEADS))]
        yield pa.RecordBatch.from_arrays([pa.array(np.unique(np.concatenate(own)))], names=["cell"])


def _counts(cells: np.ndarray | None):
    """In how many texts of either half each word and beginning occurs, block by block; cells: only those whose cell
    is set (and some others)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in T.blocks(batches):
            w = X.Words(block.column("text"))
            odd = np.array(block.column("part").to_pylist()) % 2 == 1
            for kind, keys in enumerate([w.hash, *(w.heads(k) for k in HEADS)]):
                at = np.flatnonzero(keys != 0)
                at = at if cells is None else at[cells[_cell(kind, keys[at])]]
                _, once = np.unique(T.mix(keys[at] ^ T.mix(w.doc[at].astype(np.uint64))), return_index=True)
                at = at[once]
                own, place = np.unique(keys[at], return_inverse=True)
                counts = [np.bincount(place, odd[w.doc[at]] == o, len(own)).astype(np.int64) for o in (False, True)]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(own), kind, np.int32)), pa.array(own.view(np.int64)), *map(pa.array, counts)], names=["kind", "key", "even", "odd"])

    return run


def learn_lexicons(rows: DataFrame) -> list[dict]:
    """rows: text, label, part. Entries that mark toxic texts, learnt from the even parts, the odd parts and all. Spark
    counts texts and takes the log-odds; only entries that mark toxic texts in one of the three come to the driver,
    the most telling first, MOST_ENTRIES at most (a warning says if there are more). Clean texts are counted where
    an entry of toxic ones may be, by a table of 2 ** CELL_BITS cells."""
    n = {(bool(r.label), r.odd): r["count"] for r in rows.groupBy("label", (F.col("part") % 2).alias("odd")).count().collect()}

    def counted(label: bool, cells: np.ndarray | None) -> DataFrame:
        found = rows.where(F.col("label") == label).select("text", "part").mapInArrow(_counts(cells), "kind int, key long, even long, odd long")
        return found.groupBy("kind", "key").agg(F.sum("even").alias("even"), F.sum("odd").alias("odd"))

    toxic = written(counted(True, None).where(f"even + odd >= {LEAST_TEXTS}"))
    cells = np.zeros(1 << CELL_BITS, bool)
    cells[toxic.mapInArrow(_cells, "cell long").distinct().toArrow().column("cell").to_numpy()] = True
    clean = counted(False, cells).select("kind", "key", F.col("even").alias("good_even"), F.col("odd").alias("good_odd"))
    both = toxic.join(clean, ["kind", "key"], "left").fillna(0, ["good_even", "good_odd"])
    sizes = [[sum(n.get((t, h), 0) for h in halves) + 1.0 for t in (True, False)] for halves in HALVES]

    def odds(halves: tuple[int, ...], size: list[float]):
        bad, good = (sum((F.col(c[h]) for h in halves), F.lit(0)) for c in (("even", "odd"), ("good_even", "good_odd")))
        value = F.log((bad + 0.5) / size[0]) - F.log((good + 0.5) / size[1])
        return F.when(bad >= LEAST_TEXTS, value).otherwise(0.0)

    names = [f"odds{i}" for i in range(len(HALVES))]
    told = both.select("kind", "key", *(odds(h, s).alias(c) for h, s, c in zip(HALVES, sizes, names))).withColumn("top", F.greatest(*names)).where(F.col("top") >= LEAST_ODDS)
    got = told.orderBy(F.desc("top"), "kind", "key").limit(MOST_ENTRIES + 1).toArrow()
    if got.num_rows > MOST_ENTRIES:
        logging.getLogger(__name__).warning("the lexicon has more than %d entries; the least telling are left out", MOST_ENTRIES)
        got = got.slice(0, MOST_ENTRIES)
    kind, key = got.column("kind").to_numpy(), got.column("key").to_numpy().view(np.uint64)
    out = []
    for c in names:
        value = got.column(c).to_numpy()
        lexicon = {"person": X.second_person()}
        for i, name in enumerate(("word", *(f"head{k}" for k in HEADS))):
            pick = (kind == i) & (value >= LEAST_ODDS)
            order = np.argsort(key[pick])
            lexicon[name] = key[pick][order], value[pick][order]
        out.append(lexicon)
    return out


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", most_rows: int = MOST_ROWS) -> dict:
    """A model from the labelled rows given; the caller leaves out rows that aren't to be learnt from."""
    known = labels.select(F.col("doc_id").alias("doc_id"), F.col(label).cast("int").alias("label")).where("doc_id is not null and label is not null")
    known = X.about(known, "doc_id", most_rows)
    part = F.pmod(F.xxhash64(F.lit("part"), "doc_id"), F.lit(4)).cast("int")
    rows = docs.select("doc_id", "text").join(F.broadcast(known), "doc_id")  # about most_rows pairs of numbers
    rows = written(rows.select("text", (F.col("label") > 0).alias("label"), part.alias("part")))
    rows = X.sampled(rows, 2 * most_rows)  # where labelled ids name very many rows
    *halves, lexicon = learn_lexicons(rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in T.blocks(batches):
            odd = np.array(block.column("part").to_pylist()) % 2 == 1
            x = np.where(odd[:, None], features(block.column("text"), halves[0]), features(block.column("text"), halves[1]))
            yield pa.RecordBatch.from_arrays([pa.array(list(x), pa.list_(pa.float64())), block.column("label"), block.column("part")], names=["x", "label", "part"])

    got = rows.mapInArrow(run, "x array<double>, label boolean, part int").toArrow()
    y = np.array(got.column("label").to_pylist(), float)
    model = {"lexicon": lexicon, "trees": None, "steps": (np.zeros(1), np.array([y.mean() if len(y) else 0.0]))}
    if 0 < y.sum() < len(y):
        x = np.array(got.column("x").to_pylist())
        late = np.array(got.column("part").to_pylist()) >= 2
        unseen = np.empty(len(y))
        for side in (late, ~late):
            unseen[side] = Trees().fit(x[~side], y[~side]).score(x[side]) if (~side).any() else 0.0
        model["trees"] = Trees().fit(x, y)
        model["steps"] = isotonic(unseen, y)
    return model


def score(model: dict, column: pa.Array) -> np.ndarray:
    at, value = model["steps"]
    if model["trees"] is None:
        return np.full(len(column), value[0])
    raw = model["trees"].score(features(column, model["lexicon"]))
    return np.clip(np.interp(raw, at, value), 0.0, 1.0)


def score_toxicity(docs: DataFrame, labels: DataFrame, mod: int = 4, held: int = 2, most_rows: int = MOST_ROWS) -> DataFrame:
    """doc_id, held_out, score, predicted; rows whose crc32(doc_id) mod ``mod`` is ``held`` teach nothing."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    labels = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").alias("toxic"))
    model = fit(docs, labels.where(X.remainder("doc_id", mod) != held), "toxic", most_rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in T.blocks(batches):
            s = score(model, block.column("text"))
            yield pa.RecordBatch.from_arrays([block.column("doc_id"), pa.array(s), pa.array((s >= THRESHOLD).astype(np.int32))], names=["doc_id", "score", "predicted"])

    out = docs.mapInArrow(run, "doc_id long, score double, predicted int")
    return out.select("doc_id", (X.remainder("doc_id", mod) == held).alias("held_out"), "score", "predicted")


def without_toxic(docs: DataFrame, labels: DataFrame, mod: int = 4, held: int = 2, most_rows: int = MOST_ROWS) -> DataFrame:
    """The rows of docs, all columns, whose text isn't predicted toxic; a scan without a shuffle."""
    labels = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").alias("toxic"))
    known = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    model = fit(known, labels.where(X.remainder("doc_id", mod) != held), "toxic", most_rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in T.blocks(batches):
            yield block.filter(pa.array(score(model, block.column("text")) < THRESHOLD))

    return docs.mapInArrow(run, docs.schema)
