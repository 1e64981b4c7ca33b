"""Suffix-array dedup of byte strings by bucket-pointer refinement.

Suffixes are put into buckets by their first q bytes, and a bucket is refined by the bucket identifiers of
its suffixes' later offsets: identifier(2d)[i] comes from identifier(d)[i] and identifier(d)[i + d], each
level reusing the identifiers of the level before, until depth ``length``. Identifiers are 64-bit names
of the bucket's string, so that all chunks of the corpus name a bucket alike, and sorting by identifier
gathers it. Only buckets with several members are refined, which here saves nearly all the traffic:

1. Of each string of ``length`` bytes only the suffix with the least identifier at depth length / 2 inside
   stands for it (its anchor; equal strings have the same one). A maximal run of strings that share an
   anchor is one entry: bucket of the anchor, and the identifier of the whole run.
2. Equal runs anywhere repeat as a whole. An anchor's bucket whose runs are all equal is done.
3. Only in a bucket with several different runs the strings themselves are refined to full depth, and the
   repeated buckets of that depth are the repeated strings.

Each step sends a chunk's distinct identifiers once (see _exchange), so frequent strings load no bucket.

Defined results: texts are UTF-8 bytes, null counts as empty; texts under ``length`` bytes stay whole.
Repeated rows are separate texts and repeat each other. Other columns are ignored. Matches never cross
documents.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fragmill.llm import _exchange as X
from fragmill.llm import _text as T

RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, share_removed double"
RESULT_TEXT = RESULT + ", kept binary, spans array<struct<start:long,end:long>>"
RUNS, BUCKETS, STRINGS = 0, 1, 2


def identifiers(data: np.ndarray, depth: int) -> np.ndarray:
    """Bucket identifiers of all suffixes at ``depth`` by repeated refinement from the initial q-grams."""
    steps, q = 0, depth
    while q % 2 == 0 and q > 16:
        q, steps = q // 2, steps + 1
    if len(data) < depth:
        return np.zeros(0, np.uint64)
    prefix = T.prefix_sums(T.BYTE_VALUES[data])
    ids = T.mix((prefix[q:] - prefix[:-q]) * T.powers(len(data) + 1, T.inverse())[: len(data) - q + 1])
    for _ in range(steps):
        ids = refine(ids, q)
        q *= 2
    return ids


def refine(ids: np.ndarray, d: int) -> np.ndarray:
    out = ids[:-d] * np.uint64(0xD6E8FEB86659FD93)
    out ^= out >> np.uint64(32)
    out += ids[d:] * np.uint64(0xA0761D6478BD642F)
    out ^= out >> np.uint64(29)
    out *= np.uint64(0xBF58476D1CE4E5B9)
    out ^= out >> np.uint64(32)
    return out


def sliding_min(a: np.ndarray, w: int) -> np.ndarray:
    """Minima of all w consecutive items, by prefix and suffix minima of blocks."""
    n = len(a)
    pad = -n % w
    full = np.concatenate([a, np.full(pad, np.iinfo(a.dtype).max, a.dtype)]).reshape(-1, w)
    left = np.minimum.accumulate(full, axis=1).reshape(-1)
    right = np.minimum.accumulate(full[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    return np.minimum(right[: n - w + 1], left[w - 1 : n])


class _Chunk:
    """The runs of one chunk: all strings of ``length`` bytes, grouped by their anchor."""

    def __init__(self, table: pa.Table, length: int):
        self.data, self.off = T.flat(table.column("text"))
        n, half = len(self.data), length // 2
        self.half_ids = identifiers(self.data, half)
        valid = np.zeros(n + 1, np.int32)
        has = np.diff(self.off) >= length
        np.add.at(valid, self.off[:-1][has], 1)
        np.add.at(valid, self.off[1:][has] - length + 1, -1)
        valid = np.cumsum(valid[: max(0, n - length + 1)]) > 0
        self.starts = np.flatnonzero(valid)
        if not len(self.starts):
            self.anchor = self.lo = self.hi = self.starts
            self.bucket = self.run = np.zeros(0, np.uint64)
        else:
            top = self.half_ids & np.uint64(0xFFFFFFFF00000000)
            top |= np.arange(len(top), dtype=np.uint64)
            anchor = (sliding_min(top, length - half + 1)[self.starts] & np.uint64(0xFFFFFFFF)).astype(np.int64)
            first = np.flatnonzero(np.diff(anchor, prepend=-1))
            self.lo, self.hi = self.starts[first], self.starts[np.append(first[1:], len(anchor)) - 1]
            self.anchor = anchor[first]
            self.bucket = T.mix(self.half_ids[self.anchor])  # anchors are minima: spread their names over all buckets
            prefix = T.prefix_sums(self.half_ids)  # a run as its suffixes at half depth, which are no sums of bytes
            whole = T.span_hashes(prefix, self.lo, self.hi + length - half + 1)
            self.run = T.mix(whole ^ T.mix(((self.anchor - self.lo) << 32 | (self.hi - self.lo)).astype(np.uint64)) ^ T.mix(self.bucket))
        self.runs, self.run_count, self.run_place = X.distinct(self.run)
        self.buckets, _, self.bucket_place = X.distinct(self.bucket)
        self.low, self.high = np.full(len(self.buckets), ~np.uint64(0)), np.zeros(len(self.buckets), np.uint64)
        np.minimum.at(self.low, self.bucket_place, self.run)
        np.maximum.at(self.high, self.bucket_place, self.run)

    def strings(self, hot_runs: np.ndarray, mixed: np.ndarray):
        """Places of strings to refine to full depth, their identifiers, and whether their run repeats."""
        pick = mixed[self.bucket_place]
        _, once = np.unique(self.run_place, return_index=True)
        only = np.zeros(len(pick), bool)
        only[once] = True
        pick &= only | ~hot_runs[self.run_place]
        lens = (self.hi - self.lo + 1)[pick]
        if not len(lens):
            return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, bool)
        at = np.repeat(self.lo[pick] - np.concatenate([[0], np.cumsum(lens)[:-1]]), lens) + np.arange(lens.sum())
        half = self.half_ids
        full = T.mix(half[at] + np.uint64(0x9E3779B97F4A7C15) * T.mix(half[at + self.step]))
        return at, full, np.repeat(hot_runs[self.run_place[pick]], lens)


def extremes(vals: list[np.ndarray], place: np.ndarray, n: int) -> list[np.ndarray]:
    """The least and the largest of the runs' names in each of n buckets."""
    least, most = np.full(n, ~np.uint64(0)), np.zeros(n, np.uint64)
    np.minimum.at(least, place, vals[0])
    np.maximum.at(most, place, vals[1])
    return [least, most]


def _chunk(table: pa.Table, length: int) -> _Chunk:
    got = _Chunk(table, length)
    got.step = length - length // 2
    return got


def remove_repeated_bytes(docs: DataFrame, length: int = 400, with_text: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, share_removed (of the bytes); with_text also the remaining bytes and removed spans."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    total = X.measure(docs)
    all_bits = X.bucket_bits(total // max(1, length // 4) + total // 16)
    bits = X.top(all_bits)
    dealt = X.dealt(docs, total)

    def send_runs(table: pa.Table) -> pa.Table:
        c, chunk = _chunk(table, length), table.column("chunk")[0].as_py()
        found = X.send(chunk, c.runs, [c.run_count > 1], bits, RUNS) + X.send(chunk, c.buckets, [c.low, c.high], bits, BUCKETS)
        return X.rows(found, X.SENT_ARROW)

    def judge(table: pa.Table) -> pa.Table:
        bucket = table.column("bucket")[0].as_py()
        if bucket >> bits != BUCKETS:
            return X.repeated(table)
        chunk, keys, lens, vals = X.gathered(table)
        names, _, place = X.distinct(keys)
        least, most = extremes(vals, place, len(names))
        return X.rows(X.replies(chunk, bucket, lens, [(least != most)[place]]), X.REPLY_ARROW)

    def verdicts(c: _Chunk, replies: pa.Table):
        return X.answered_flags(replies, c.runs, bits, RUNS), X.answered_flags(replies, c.buckets, bits, BUCKETS)

    def send_strings(table: pa.Table, replies: pa.Table) -> pa.Table:
        if not table.num_rows:
            return X.rows([], X.SENT_ARROW)
        c, chunk = _chunk(table, length), table.column("chunk")[0].as_py()
        _, full, hot = c.strings(*verdicts(c, replies))
        keys, count, place = X.distinct(full)
        many = count > 1
        many[place[hot]] = True
        return X.rows(X.send(chunk, keys, [many], bits, STRINGS), X.SENT_ARROW)

    def finish(table: pa.Table, replies: pa.Table) -> pa.Table:
        c = _chunk(table, length)
        hot_runs, mixed = verdicts(c, replies)
        at, full, _ = c.strings(hot_runs, mixed)
        keys, _, place = X.distinct(full)
        hot = X.answered_flags(replies, keys, bits, STRINGS)[place]
        step = np.zeros(len(c.data) + 1, np.int32)
        runs = hot_runs[c.run_place]
        np.add.at(step, c.lo[runs], 1)
        np.add.at(step, c.hi[runs] + length, -1)
        np.add.at(step, at[hot], 1)
        np.add.at(step, at[hot] + length, -1)
        keep = np.cumsum(step[:-1]) == 0
        edge = ~keep
        edge[1:] &= keep[:-1]
        edge[c.off[:-1][c.off[:-1] < len(keep)]] |= ~keep[c.off[:-1][c.off[:-1] < len(keep)]]
        gone, spans = np.concatenate([[0], np.cumsum(~keep)]), np.concatenate([[0], np.cumsum(edge)])
        a, b = c.off[:-1], c.off[1:]
        kept = [c.data[i:j].tobytes() if gone[i] == gone[j] else c.data[i:j][keep[i:j]].tobytes() for i, j in zip(a, b)]
        out = {
            "doc_id": table.column("doc_id"),
            "n_bytes": pa.array(b - a, pa.int64()),
            "n_removed": pa.array(gone[b] - gone[a], pa.int64()),
            "n_spans": pa.array(spans[b] - spans[a], pa.int64()),
            "kept_sha256": pa.array([hashlib.sha256(x).hexdigest() for x in kept], pa.string()),
            "share_removed": pa.array((gone[b] - gone[a]) / np.maximum(b - a, 1)),
        }
        if with_text:
            from fragmill.llm.substring import _runs

            out["kept"] = pa.array(kept, pa.binary())
            out["spans"] = pa.array([_runs(~keep[i:j]) for i, j in zip(a, b)], pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))
        return pa.table(out)

    merges = {RUNS: X.merged_flags, BUCKETS: extremes, STRINGS: X.merged_flags}
    first = X.exchanged(dealt.groupBy("chunk").applyInArrow(send_runs, X.SENT), judge, all_bits, merges)
    second = dealt.groupBy("chunk").cogroup(first.groupBy("chunk")).applyInArrow(send_strings, X.SENT)
    second = X.exchanged(second, X.repeated, all_bits, merges)
    return dealt.groupBy("chunk").cogroup(first.union(second).groupBy("chunk")).applyInArrow(finish, RESULT_TEXT if with_text else RESULT)
