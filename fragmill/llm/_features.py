"""Dense features of whole texts, by whole-array operations; labels, lang, source and ids never enter."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fragmill.llm import _text as T

KINDS = ("lower", "upper", "digit", "blank", "line", "beyond", "stop", "shout", "bar", "mark", "other")
KIND = np.full(256, 10, np.uint8)
KIND[97:123], KIND[65:91], KIND[48:58], KIND[128:] = 0, 1, 2, 5
for _i, _chars in ((3, b" \t\x0b\x0c"), (4, b"\n\r"), (6, b".,;:"), (7, b"!?"), (8, b"|"), (9, b"%$&#*@")):
    KIND[list(_chars)] = _i
PUNCT = KIND >= 6
SECOND_PERSON = "you your yours yourself u ur tu tú te ti usted ustedes vous toi ton ta tes votre vos du dich dir dein deine ihr euch sie".split()
STYLE = [*KINDS, "log_bytes", "log_words", "word_mean", "word_max", "same_as_before", "distinct", "capital_words", "stopped_words", "marked_words", "mixed_words", "drawn_out", "line_words"]
NEARBY = 5


class Words:
    """The words of a block of texts with hashes: lower-cased, without trailing punctuation."""

    def __init__(self, column: pa.Array):
        self.data, self.off = T.flat(column)
        self.st, en, self.word_off = T.words(self.data, self.off)
        self.en = en
        end = en.copy()
        for _ in range(3):
            cut = PUNCT[self.data[end - 1]] & (end - 1 > self.st)
            end = end - cut
        self.end = end
        self.small = T.LOWER[self.data]
        self.hash = self.named(self.end)
        self.doc = np.repeat(np.arange(len(self.off) - 1), np.diff(self.word_off))

    def named(self, end: np.ndarray) -> np.ndarray:
        return T.span_names(self.small, self.st, end)

    def heads(self, n: int) -> np.ndarray:
        """Hashes of the words' first n bytes; 0 for words that aren't longer."""
        long = self.end - self.st > n
        return np.where(long, self.named(np.where(long, self.st + n, self.end)) ^ np.uint64(n), 0)

    def per_doc(self, values: np.ndarray | None = None, where: np.ndarray | None = None) -> np.ndarray:
        doc = self.doc if where is None else self.doc[where]
        values = values if values is None or where is None else values[where]
        return np.bincount(doc, values, len(self.off) - 1).astype(float)


def style(w: Words) -> np.ndarray:
    n = len(w.off) - 1
    size = np.diff(w.off)
    byte_doc = np.repeat(np.arange(n), size)
    kinds = KIND[w.data]
    count = np.bincount(byte_doc * len(KINDS) + kinds, minlength=n * len(KINDS)).reshape(n, -1)
    rate = count / np.maximum(size, 1)[:, None]
    words = np.diff(w.word_off)
    per = np.maximum(words, 1)
    length = w.en - w.st
    longest = np.zeros(n)
    if len(length):
        np.maximum.at(longest, w.doc, length)
    same = np.zeros(len(w.hash), bool)
    same[1:] = (w.hash[1:] == w.hash[:-1]) & (w.doc[1:] == w.doc[:-1])
    own = np.unique(T.mix(w.hash ^ T.mix(w.doc.astype(np.uint64))), return_index=True)[1]
    upper = np.concatenate([[0], np.cumsum(kinds == 1)])
    letters = np.concatenate([[0], np.cumsum((kinds <= 1) | (kinds == 5))])
    inside = np.concatenate([[0], np.cumsum((kinds == 2) | (kinds == 9))])
    up, lt = upper[w.en] - upper[w.st], letters[w.end] - letters[w.st]
    mixed = (lt >= 2) & (inside[w.end] - inside[w.st] > 0)
    drawn = np.zeros(len(w.data), bool)
    if len(w.data) > 2:
        drawn[2:] = (w.data[2:] == w.data[1:-1]) & (w.data[1:-1] == w.data[:-2]) & (kinds[2:] <= 1)
    last = kinds[w.en - 1] if len(w.en) else kinds[:0]
    cols = [
        np.log1p(size),
        np.log1p(words),
        w.per_doc(length) / per,
        np.log1p(longest),
        w.per_doc(where=same) / per,
        np.bincount(w.doc[own], minlength=n) / per,
        w.per_doc(where=(up >= 2) & (up * 2 > length)) / per,
        w.per_doc(where=last == 6) / per,
        w.per_doc(where=last >= 7) / per,
        w.per_doc(where=mixed) / per,
        np.bincount(byte_doc[drawn], minlength=n) / np.maximum(size, 1),
        np.log1p(words / np.maximum(count[:, 4] + 1, 1)),
    ]
    return np.column_stack([rate, *cols])


def second_person() -> np.ndarray:
    w = Words(pa.array([" ".join(SECOND_PERSON)]))
    return np.sort(w.hash)


def member(sorted_keys: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Places of keys among sorted distinct keys; -1 where there is none."""
    if not len(sorted_keys):
        return np.full(len(keys), -1)
    at = np.minimum(np.searchsorted(sorted_keys, keys), len(sorted_keys) - 1)
    return np.where(sorted_keys[at] == keys, at, -1)


def remainder(doc_id: str, mod: int) -> Column:
    """crc32 of the id as text, modulo mod; a null id counts as an empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")), F.lit(mod))


def sampled(df: DataFrame, most: int) -> DataFrame:
    """All rows, or a random sample of them with a hard bound near ``most``, whatever ids or texts repeat. df should be
    a written table, so that a task that is run again draws the same rows."""
    n = df.count()
    return df if n <= most else df.where(F.rand(17) < most / n).limit(most + most // 10)


def about(df: DataFrame, key: str, most: int) -> DataFrame:
    """All rows, or about ``most`` of them, chosen by a hash of key: a bounded sample for fitting a model."""
    n = df.count()
    return df if n <= most else df.where(F.pmod(F.xxhash64(F.lit("sample"), key), F.lit(1 << 30)) < int((1 << 30) * most / n))
