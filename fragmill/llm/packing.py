"""Packing of tokenised documents into sequences by an order-preserving dynamic programme.

Documents keep the order in which they are read. Inside a block of documents the programme chooses cuts
among document ends, sentence ends and (where a stretch has neither) forced places, and minimises padding
plus a penalty for each cut that truncates a document. A sequence of n tokens costs limit - n of padding,
so the cost of a cut at p after a cut at q is f(q) + q plus a constant of p: the best q in the window is
kept in a monotone queue, and each place is handled once. A sequence whose length is a power of two
needs no padding; those lengths are tried beside the queue.

Blocks are runs of rows of one partition, so packing needs no shuffle and no state beyond a block; the last
sequence of a block is the only one that a block's end can shorten.

Defined results: null counts as empty text; an empty text is its end token alone; a text longer than a
sequence is cut; repeated rows are packed each for itself; an empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fragmill.llm import _text as T

TOKENIZER = "byte_bpe_50k.json"
LIMIT = 2048
END = 1
SENTENCE_CUT, FORCED_CUT, PER_SEQUENCE = 2, 40, 4
BLOCK_BYTES = 2 << 20
FORCED_STEP = 32  # parts of a sequence; a stretch without a boundary offers a place to cut after each
KNOWN_PIECES = 2_000_000
RESULT = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
SCHEMA = pa.schema([(x.split()[0], pa.int64()) for x in RESULT.split(", ")])


class Encoder:
    """Ids of a byte-level BPE. Plain Latin texts are cut into pieces by whole-array operations and each
    distinct piece is encoded once; any other text, and one that spells a special token, goes through the
    tokenizer itself."""

    LETTER, DIGIT, OTHER, SPACE, BREAK = 1, 2, 3, 4, 5

    def __init__(self, path: str):
        import unicodedata

        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.kind = np.zeros(0x250, np.uint8)
        for c in range(0x250):
            cat = unicodedata.category(chr(c))[0]
            self.kind[c] = self.LETTER if cat == "L" else self.DIGIT if cat == "N" else self.OTHER
        self.kind[0x20], self.kind[0x0A], self.kind[0x09] = self.SPACE, self.BREAK, self.BREAK
        self.plain = np.ones(0x250, bool)
        self.plain[:0x20] = self.plain[0x7F:0xA1] = self.plain[0x27] = False
        self.plain[[0x20, 0x0A, 0x09]] = True
        self.pieces = self._piece_encoder(path)
        self.forget()

    def forget(self) -> None:
        """Empties the table of encoded pieces: names in order, and for each where its ids are."""
        self.names, self.base = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.lens, self.ids = np.zeros(0, np.int64), np.zeros(0, np.uint32)

    def _piece_encoder(self, path: str):
        """Encodes pieces joined by NUL, which no plain text holds."""
        import json

        import tiktoken

        names = {}
        for b in range(256):
            names[b] = b if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255 else None
        spare = 256
        for b in range(256):
            if names[b] is None:
                names[b], spare = spare, spare + 1
        back = {chr(v): k for k, v in names.items()}
        with open(path, encoding="utf-8") as f:
            vocab = json.load(f)["model"]["vocab"]
        ranks = {bytes(back[c] for c in token): i for token, i in vocab.items() if all(c in back for c in token) and token not in self.special}
        self.nul = ranks[b"\0"]
        return tiktoken.Encoding("pieces", pat_str="[^\x00]+|\x00", mergeable_ranks=ranks, special_tokens={})

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        points = [np.frombuffer(t.encode("utf-32-le", "surrogatepass"), np.uint32) for t in texts]
        easy = [not len(p) or (p.max() < 0x250 and self.plain[p].all() and not any(s in t for s in self.special)) for p, t in zip(points, texts)]
        out: list[np.ndarray] = [np.zeros(0, np.uint32)] * len(texts)
        hard = [i for i, e in enumerate(easy) if not e]
        for i, e in zip(hard, self.tokenizer.encode_batch([texts[i] for i in hard], add_special_tokens=False) if hard else []):
            out[i] = np.array(e.ids, np.uint32)
        index = [i for i, e in enumerate(easy) if e and len(points[i])]
        if index:
            flat = np.concatenate([points[i] for i in index])
            off = np.concatenate([[0], np.cumsum([len(points[i]) for i in index])])
            for i, ids in zip(index, self._plain(flat, off)):
                out[i] = ids
        return out

    def _plain(self, flat: np.ndarray, off: np.ndarray) -> list[np.ndarray]:
        n = len(flat)
        kind = self.kind[flat]
        space = kind >= self.SPACE
        text_start = np.zeros(n + 1, bool)
        text_start[off] = True
        # a piece begins where the kind changes; white space keeps together but for the last of a run, which
        # goes to what follows if it is a blank and stands alone if not
        begin = np.ones(n, bool)
        begin[1:] = np.where(space[1:], ~space[:-1], kind[1:] != kind[:-1])
        begin |= text_start[:n]
        before = np.zeros(n, bool)  # white space right before a word of the same text
        before[:-1] = space[:-1] & ~space[1:] & ~text_start[1:n]
        begin |= before
        joined = np.flatnonzero(before & (kind == self.SPACE)) + 1
        begin[joined] = False
        start = np.flatnonzero(begin)
        end = np.append(start[1:], n)
        name = T.span_names(flat.astype("<u2").view(np.uint8), 2 * start, 2 * end)
        names, first, place = np.unique(name, return_index=True, return_inverse=True)
        if len(self.names) > KNOWN_PIECES:
            self.forget()
        at = np.searchsorted(self.names, names)
        new = np.flatnonzero(np.append(self.names, 0)[at] != names) if len(self.names) else np.arange(len(names))
        if len(new):
            self._learn(flat, names[new], start[first[new]], end[first[new]])
            at = np.searchsorted(self.names, names)
        base, lens = self.base[at], self.lens[at]
        size = lens[place]
        to = np.cumsum(size)
        at = np.repeat(base[place] - (to - size), size) + np.arange(to[-1])
        tokens = self.ids[at]
        cut = np.concatenate([[0], to])[np.searchsorted(start, off)]
        return [tokens[a:b] for a, b in zip(cut[:-1], cut[1:])]

    def _learn(self, flat: np.ndarray, names: np.ndarray, start: np.ndarray, end: np.ndarray) -> None:
        size = end - start + 1
        to = np.cumsum(size)
        at = np.repeat(start - (to - size), size) + np.arange(to[-1])
        joined = np.append(flat, np.uint32(0))[at]
        joined[to - 1] = 0
        ids = self.pieces.encode_to_numpy(joined.tobytes().decode("utf-32-le"), disallowed_special=())
        stop = np.flatnonzero(ids == self.nul)
        begin = np.append(0, stop[:-1] + 1)
        names_all = np.concatenate([self.names, names])
        order = np.argsort(names_all, kind="stable")
        self.base = np.concatenate([self.base, begin + len(self.ids)])[order]
        self.lens = np.concatenate([self.lens, stop - begin])[order]
        self.names, self.ids = names_all[order], np.concatenate([self.ids, ids.astype(np.uint32)])


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def sentence_ends(path: str) -> np.ndarray:
    """Of each id, whether its text ends a sentence or a line."""
    tok = encoder(path).tokenizer
    size = tok.get_vocab_size()
    out = np.zeros(size + 1, bool)
    for token, i in tok.get_vocab().items():
        out[i] = token[-1:] in (".", "!", "?", "Ċ")
    return out


def choose_cuts(places: np.ndarray, penalty: np.ndarray, limit: int = LIMIT) -> np.ndarray:
    """Least-cost cuts among sorted places (first 0, last the end) with a penalty each; neighbours are at most
    ``limit`` apart. Cost: padding, penalties and PER_SEQUENCE for each sequence."""
    p, pen = places.tolist(), penalty.tolist()
    n = len(p)
    cost, back = [0.0] * n, [0] * n
    exact = {}
    size = limit >> 1
    while size >= max(64, limit >> 4):
        at = np.searchsorted(places, places - size)
        hit = places[at] == places - size
        for i in np.flatnonzero(hit).tolist():
            exact.setdefault(i, []).append(int(at[i]))
        size >>= 1
    queue: deque[tuple[float, int, int]] = deque([(0.0, 0, 0)])
    none = ()
    for i in range(1, n):
        here = p[i]
        low = here - limit
        while queue[0][1] < low:
            queue.popleft()
        head = queue[0]
        best, prev = head[0] + limit - here, head[2]
        for j in exact.get(i, none):
            if cost[j] < best:
                best, prev = cost[j], j
        best += pen[i] + PER_SEQUENCE
        cost[i], back[i] = best, prev
        key = best + here
        while queue and queue[-1][0] >= key:
            queue.pop()
        queue.append((key, here, i))
    cuts = [n - 1]
    while cuts[-1]:
        cuts.append(back[cuts[-1]])
    return places[cuts[::-1]]


def pack_block(ids: list[np.ndarray], ends: np.ndarray, limit: int = LIMIT):
    """Pieces (document, start, length, sequence, offset) of the documents' ids, each with its end id."""
    lens = np.array([len(x) for x in ids], np.int64)
    off = np.concatenate([[0], np.cumsum(lens)])
    flat = np.concatenate(ids)
    stop = np.flatnonzero(ends[np.minimum(flat, len(ends) - 1)]) + 1
    places, kinds = np.concatenate([off, stop]), np.concatenate([np.zeros(len(off)), np.full(len(stop), SENTENCE_CUT)])
    wide = np.unique(places)
    step = max(1, limit // FORCED_STEP)
    gaps = np.flatnonzero(np.diff(wide) > step)
    if len(gaps):  # stretches without a boundary
        forced = np.concatenate([np.arange(wide[g] + step, wide[g + 1], step) for g in gaps])
        places, kinds = np.concatenate([places, forced]), np.concatenate([kinds, np.full(len(forced), FORCED_CUT)])
    order = np.lexsort((kinds, places))
    places, kinds = places[order], kinds[order]
    keep = np.concatenate([[True], places[1:] != places[:-1]])
    cuts = choose_cuts(places[keep], kinds[keep], limit)
    edges = np.unique(np.concatenate([cuts, off]))
    start, length = edges[:-1], np.diff(edges)
    doc = np.searchsorted(off, start, "right") - 1
    sequence = np.searchsorted(cuts, start, "right") - 1
    return flat, doc, start - off[doc], length, sequence, start - cuts[sequence], start


def pack(docs: DataFrame, limit: int = LIMIT, tokenizer: str | None = None, with_ids: bool = False) -> DataFrame:
    """A row per piece; with_ids also the ids themselves. ``tokenizer``: path of a byte-level BPE file (by
    default the public 50k one)."""
    if tokenizer is None:
        import public_tokenizers

        tokenizer = public_tokenizers.path(TOKENIZER)
    path = str(tokenizer)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, ends = encoder(path), sentence_ends(path)
        base = TaskContext.get().partitionId() << 40
        for block in T.blocks(batches, "text", BLOCK_BYTES):
            texts = block.column("text").fill_null("").to_pylist()
            ids = [np.append(x, np.uint32(END)) for x in enc.encode(texts)]
            flat, doc, start, length, sequence, offset, at = pack_block(ids, ends, limit)
            flat = flat.astype("<u4")
            sums = [zlib.crc32(flat[a : a + n]) for a, n in zip(at.tolist(), length.tolist())]
            total = np.array([len(x) for x in ids])
            doc_ids = block.column("doc_id").take(pa.array(doc))
            cols = [doc_ids, start, length, np.array(sums, np.int64), total[doc], sequence + base, offset]
            out = [pa.array(c, pa.int64()) if isinstance(c, np.ndarray) else c for c in cols]
            if with_ids:
                out.append(pa.array([flat[a : a + n].tolist() for a, n in zip(at.tolist(), length.tolist())], pa.list_(pa.int64())))
            yield pa.RecordBatch.from_arrays(out, schema=SCHEMA.append(pa.field("ids", pa.list_(pa.int64()))) if with_ids else SCHEMA)
            base += int(sequence[-1]) + 1

    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return docs.mapInArrow(run, RESULT + ", ids array<long>" if with_ids else RESULT)
