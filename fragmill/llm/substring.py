"""Substring dedup: Rabin-Karp hashes of every window of consecutive words, counted over the corpus.

Every window of every whole text is hashed and counted (see _exchange for how the counts are spread);
repeated windows of a document merge into maximal intervals of words, which are removed. Windows are
judged on the input, so that all copies of a repeated passage go, also within one document.

Defined results: a null or empty text has no words, removes nothing and keeps the empty string. Texts
shorter than a window remove nothing. Repeated rows (same id, same text) are separate texts, so they
repeat each other. Other columns of the input are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fragmill.llm import _exchange as X
from fragmill.llm import _text as T

RESULT = "doc_id long, n_words long, n_removed long, kept_sha256 string, kept string, spans array<struct<start:long,end:long>>"


def _windows(table: pa.Table, k: int):
    data, off = T.flat(table.column("text"))
    st, en, word_off = T.words(data, off)
    keys, at = T.windows(T.word_hashes(data, st, en), word_off, k)
    return data, off, st, en, word_off, at, X.distinct(keys)


def remove_repeated_windows(docs: DataFrame, k: int = 35, with_text: bool = False) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256; with_text also the kept text and the removed word spans."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    total = X.measure(docs)
    all_bits = X.bucket_bits(total // 6)
    bits = X.top(all_bits)
    dealt = X.dealt(docs, total)

    def send(table: pa.Table) -> pa.Table:
        *_, (keys, count, _) = _windows(table, k)
        return X.rows(X.send(table.column("chunk")[0].as_py(), keys, [count > 1], bits), X.SENT_ARROW)

    def finish(table: pa.Table, replies: pa.Table) -> pa.Table:
        data, off, st, en, word_off, at, (keys, _, place) = _windows(table, k)
        hot = X.answered_flags(replies, keys, bits)
        gone = T.covered(at[hot[place]], k, len(st))
        lead = np.concatenate([[0], np.cumsum(gone)])
        texts = kept_texts(data, off, st[~gone], en[~gone])
        out = {
            "doc_id": table.column("doc_id"),
            "n_words": pa.array(np.diff(word_off), pa.int64()),
            "n_removed": pa.array(lead[word_off[1:]] - lead[word_off[:-1]], pa.int64()),
            "kept_sha256": pa.array([hashlib.sha256(x).hexdigest() for x in texts], pa.string()),
        }
        if with_text:
            out["kept"] = pa.array([x.decode() for x in texts], pa.string())
            out["spans"] = pa.array([_runs(gone[a:b]) for a, b in zip(word_off[:-1], word_off[1:])], pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))
        return pa.table(out)

    replies = X.exchanged(dealt.groupBy("chunk").applyInArrow(send, X.SENT), X.repeated, all_bits, {0: X.merged_flags})
    schema = RESULT if with_text else RESULT.partition(", kept string")[0]
    return dealt.groupBy("chunk").cogroup(replies.groupBy("chunk")).applyInArrow(finish, schema)


def kept_texts(data: np.ndarray, off: np.ndarray, st: np.ndarray, en: np.ndarray) -> list[bytes]:
    """For each document its given words joined by one space."""
    step = np.zeros(len(data) + 2, np.int8)
    ends = np.append(off[1:], 0)[np.searchsorted(off[1:], en)] if len(en) else en
    step[st] += 1
    step[np.minimum(en + 1, ends)] -= 1
    keep = np.cumsum(step[: len(data)], dtype=np.int8) > 0
    spaced = np.where(T.WHITE[data], np.uint8(32), data)
    return [spaced[a:b][keep[a:b]].tobytes().rstrip(b" ") for a, b in zip(off[:-1], off[1:])]


def _runs(gone: np.ndarray) -> list[dict]:
    edges = np.flatnonzero(np.diff(np.concatenate([[0], gone.astype(np.int8), [0]])))
    return [{"start": int(a), "end": int(b)} for a, b in edges.reshape(-1, 2)]
