"""Quality classifier by positive-unlabelled learning.

Trusted positives are the labelled rows of quality 1; the rest of the web text is unlabelled. A network g
minimises the non-negative unbiased risk  prior * R+(g) + max(0, R-_unlabelled(g) - prior * R-_positive(g)),
with logistic loss. Its output is calibrated on rows it hasn't seen, again from positives and unlabelled
texts alone: prior * density among positives / density among unlabelled, made monotone. The class prior is estimated from a classifier of
positives against unlabelled texts: the least ratio, over score thresholds, of the unlabelled share above a
threshold to the positive share above it, with a margin for the sample's size.

The networks are fitted on bounded samples (``most_rows`` each); the shares of unlabelled texts in the prior and in the
calibration come from histograms of all texts' outputs. Features are computed once, for every whole text. Rows of
quality 0 are never used.

Defined results: null counts as empty text; without positives or texts every score is 0.5; repeated rows get
equal scores; several labels of an id count as several rows; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fragmill.llm import _features as X
from fragmill.llm import _text as T
from fragmill.llm._tables import written
from fragmill.llm.toxicity import isotonic

MOST_ROWS = 20_000
THRESHOLD = 0.3
BINS = 4096
HIDDEN, STEPS, BATCH, RATE = 24, 1500, 512, 0.01


class Net:
    """One hidden layer; parameters as a list of arrays, trained by Adam."""

    def __init__(self, n: int, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.w = [rng.normal(0, n**-0.5, (n, HIDDEN)), np.zeros(HIDDEN), rng.normal(0, HIDDEN**-0.5, HIDDEN), np.zeros(1)]

    def out(self, x: np.ndarray) -> np.ndarray:
        return np.tanh(x @ self.w[0] + self.w[1]) @ self.w[2] + self.w[3][0]

    def slope(self, x: np.ndarray, d: np.ndarray) -> list[np.ndarray]:
        """Gradient of a loss whose derivative by the outputs is d."""
        h = np.tanh(x @ self.w[0] + self.w[1])
        back = np.outer(d, self.w[2]) * (1 - h * h)
        return [x.T @ back, back.sum(axis=0), h.T @ d, np.array([d.sum()])]

    def train(self, gradient, steps: int = STEPS) -> Net:
        m = [np.zeros_like(w) for w in self.w]
        v = [np.zeros_like(w) for w in self.w]
        for t in range(1, steps + 1):
            rate = RATE * (1 - t / (steps + 1))
            for i, g in enumerate(gradient(self)):
                g = g + 1e-4 * self.w[i]
                m[i] = 0.9 * m[i] + 0.1 * g
                v[i] = 0.999 * v[i] + 0.001 * g * g
                self.w[i] = self.w[i] - rate * (m[i] / (1 - 0.9**t)) / (np.sqrt(v[i] / (1 - 0.999**t)) + 1e-8)
        return self


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def estimate_prior(positive: np.ndarray, unlabelled: np.ndarray, seed: int = 11, counts=None) -> float:
    """Best-bin estimate on halves that the classifier hasn't seen; counts(net, edges): how many of all texts lie in
    each bin (by default those of the other half)."""
    rng = np.random.default_rng(seed)
    p, u = positive[0::2], unlabelled[0::2]

    def gradient(net: Net):
        a, b = p[rng.integers(0, len(p), BATCH)], u[rng.integers(0, len(u), BATCH)]
        x = np.concatenate([a, b])
        y = np.repeat([1.0, 0.0], [len(a), len(b)])
        return net.slope(x, (sigmoid(net.out(x)) - y) / len(x))

    net = Net(positive.shape[1]).train(gradient, STEPS // 2)
    sp, su = np.sort(net.out(positive[1::2])), np.sort(net.out(unlabelled[1::2]))
    if not len(sp) or not len(su):
        return 0.5
    at = np.unique(np.concatenate([sp, su]))
    n = len(su)
    if counts is None:
        above_u = 1 - np.searchsorted(su, at, "left") / n
    else:
        at = grid(at)
        held = counts(net, at)
        n = held.sum()
        above_u = np.cumsum(held[::-1])[::-1][1:] / n
    above_p = 1 - np.searchsorted(sp, at, "left") / len(sp)
    margin = np.sqrt(np.log(40) / 2) * (len(sp) ** -0.5 + n**-0.5)
    ok = above_p > 0.1
    best = np.argmin((above_u[ok] + margin) / above_p[ok])
    return float(np.clip((above_u[ok] / above_p[ok])[best], 0.02, 0.98))


def grid(values: np.ndarray) -> np.ndarray:
    """At most BINS edges, spread over the sorted distinct values."""
    return values if len(values) <= BINS else values[np.linspace(0, len(values) - 1, BINS).astype(int)]


def fit(positive: np.ndarray, unlabelled: np.ndarray, prior: float | None = None, counts=None) -> dict:
    """counts(scaled, net, edges): how many of all texts have outputs below the first edge, in each bin, and from the
    last edge on (by default the unlabelled sample's other half stands for all)."""
    both = np.concatenate([positive, unlabelled])
    middle, spread = np.median(both, axis=0), both.std(axis=0) + 1e-6

    def scaled(x: np.ndarray) -> np.ndarray:
        return np.clip((x - middle) / spread, -6, 6)

    prior = estimate_prior(scaled(positive), scaled(unlabelled), counts=counts and (lambda net, at: counts(scaled, net, at))) if prior is None else prior
    p, u = scaled(positive[0::2]), scaled(unlabelled[0::2])
    rng = np.random.default_rng(5)

    def gradient(net: Net):
        a, b = p[rng.integers(0, len(p), BATCH)], u[rng.integers(0, len(u), BATCH)]
        ga, gb = net.out(a), net.out(b)
        rest = np.logaddexp(0, gb).mean() - prior * np.logaddexp(0, ga).mean()  # risk of the negatives
        d_rest = [sigmoid(gb) / len(b), -prior * sigmoid(ga) / len(a)]
        x = np.concatenate([a, b])
        if rest >= 0:
            d = np.concatenate([prior * -sigmoid(-ga) / len(a) + d_rest[1], d_rest[0]])
        else:  # a negative risk is overfitting: step back from it
            d = -np.concatenate([d_rest[1], d_rest[0]])
        return net.slope(x, d)

    net = Net(p.shape[1]).train(gradient)
    sp, su = net.out(scaled(positive[1::2])), net.out(scaled(unlabelled[1::2]))
    weight = np.ones(len(su))
    if counts is not None:  # bins of all texts in place of the sample, at the sample's weight
        edges = grid(np.unique(np.concatenate([sp, su])))
        held = counts(scaled, net, edges)
        weight, su_at = held * (len(su) / max(held.sum(), 1)), np.concatenate([[edges[0] - 1e-9], edges])
    else:
        su_at = su
    at, share = isotonic(np.concatenate([sp, su_at]), np.repeat([1.0, 0.0], [len(sp), len(su_at)]), np.concatenate([np.ones(len(sp)), weight]))
    value = np.clip(prior * len(su) / max(len(sp), 1) * share / np.maximum(1 - share, 1e-9), 0, 1)
    return {"net": net, "middle": middle, "spread": spread, "prior": prior, "steps": (at, value)}


def score(model: dict | None, x: np.ndarray) -> np.ndarray:
    if model is None:
        return np.full(len(x), 0.5)
    raw = model["net"].out(np.clip((x - model["middle"]) / model["spread"], -6, 6))
    return 0.98 * np.interp(raw, *model["steps"]) + 0.02 * sigmoid(raw)


def _vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for block in T.blocks(batches):
        x = X.style(X.Words(block.column("text")))
        yield pa.RecordBatch.from_arrays([block.column("doc_id"), pa.array([r.tobytes() for r in x], pa.binary())], names=["doc_id", "x"])


def _matrix(column) -> np.ndarray:
    raw = b"".join(column.to_pylist())
    return np.frombuffer(raw).reshape(len(column), -1) if raw else np.zeros((0, len(X.STYLE)))


def learn(vectors: DataFrame, positives: DataFrame, most_rows: int = MOST_ROWS) -> dict | None:
    """vectors: doc_id, x of all texts, written; positives: doc_id of trusted rows."""
    known = X.about(positives.where("doc_id is not null").distinct(), "doc_id", most_rows)
    rows = vectors.join(F.broadcast(known), "doc_id", "left_semi")  # a broadcast of about most_rows ids
    p, u = (_matrix(X.sampled(df.select("x"), most_rows).toArrow().column("x")) for df in (written(rows), vectors))

    def counts(scaled, net: Net, edges: np.ndarray) -> np.ndarray:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held = np.zeros(len(edges) + 1, np.int64)
            for batch in batches:
                held += np.bincount(np.searchsorted(edges, net.out(scaled(_matrix(batch.column("x")))), "right"), minlength=len(held))
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(held))), pa.array(held)], names=["bin", "held"])

        got = vectors.select("x").mapInArrow(run, "bin long, held long").groupBy("bin").agg(F.sum("held").alias("held")).toArrow()
        held = np.zeros(len(edges) + 1)
        held[got.column("bin").to_numpy()] = got.column("held").to_numpy()
        return held

    return fit(p, u, counts=counts) if len(p) > 3 and len(u) > 3 else None


def score_quality(docs: DataFrame, labels: DataFrame, mod: int = 5, held: int = 0, most_rows: int = MOST_ROWS) -> DataFrame:
    """doc_id, held_out, score, predicted; rows whose crc32(doc_id) mod ``mod`` is ``held`` teach nothing."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    vectors = written(docs.mapInArrow(_vectors, "doc_id long, x binary"))
    trusted = labels.where("quality = 1").select(F.col("doc_id").cast("long").alias("doc_id"))
    model = learn(vectors, trusted.where(X.remainder("doc_id", mod) != held), most_rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s = score(model, _matrix(batch.column("x")))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(s), pa.array((s >= THRESHOLD).astype(np.int32))], names=["doc_id", "score", "predicted"])

    out = vectors.mapInArrow(run, "doc_id long, score double, predicted int")
    return out.select("doc_id", (X.remainder("doc_id", mod) == held).alias("held_out"), "score", "predicted")
