"""LM scoring with a probabilistic suffix tree over words.

States are contexts of the last tokens, of any number up to ``longest``. A context is kept if its divergence from
its parent pays: the sum, over its occurrences in training texts, of the log-ratio of its next-symbol
probability to its parent's, each with the occurrence itself left out. Next-symbol distributions are
smoothed with the parent's, p(w | c) = (n(c, w) + m * p(w | parent)) / (n(c) + m), and the strength m is the
one of STRENGTHS whose left-out sum is largest. A token is scored in the longest kept suffix of its history;
probabilities of a state sum to one over the training vocabulary and one unknown token.

All counts cover all training texts and stay in Spark. Texts are tokenised once into chunks (about CHUNK_BYTES of
text of one partition, as places in the chunk's list of distinct words), which are written and read by all later
steps. Chunks send their distinct n-grams and get the global counts of just these back (see _exchange), words and
pairs first. All contexts of one and two words that occur LEAST_COUNT times are put to the test: chunks send the
left-out sums of their contexts (in units of UNIT nats, which moves a sum by less than that a chunk) and get the decisions back, one word first, as a kept
context of one word is the parent of longer ones. What a chunk then knows of its tokens is written,
so that later steps ask and read only what is open. From three words on the tree grows level by level: a context is
tried if its parent is kept. Chunks send its next tokens with their counts and their left-out probability in the
parent, which is the same wherever the n-gram stands, so that one round counts and decides a level; the levels end
with the first that keeps none. Names of n-grams above words, and of contexts, have so many bits that about one n-gram in 2**18 shares a name (for an n-gram each
six bytes); words have 64. ``exact`` gives all names 64 bits and loses no precision in messages.

Defined results: null counts as empty text, which is its end token; rows without doc_id count as id "" (held
out); without training texts every probability is that of the unknown token; repeated rows each teach and get
equal scores.
"""

from __future__ import annotations

import math
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fragmill.llm import _exchange as X
from fragmill.llm import _text as T
from fragmill.llm._tables import dropped, written

CHUNK = "chunk long, ids array<long>, crcs binary, lens binary, names binary, places binary"
CHUNK_ARROW = pa.schema([("chunk", pa.int64()), ("ids", pa.list_(pa.int64())), ("crcs", pa.binary()), ("lens", pa.binary()), ("names", pa.binary()), ("places", pa.binary())])
END = np.uint64(0xE0DE0DE0DE0DE0D)
STRENGTHS = (0.5, 4.0, 32.0)
LEAST_GAIN, LEAST_COUNT = 3.0, 2
UNIT, PARENT = 2.0**-8, np.float32  # of left-out sums in messages (nats), of left-out probabilities
EXACT_UNIT, EXACT_PARENT = 2.0**-30, np.float64
CHUNK_BYTES = 8 << 20
PRIOR = 0.1
WORD, PAIR, TRIPLE = 0, 1, 2
SETTLED = -2  # the bucket of a row with what a chunk knows of its own tokens
RESULT = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def _crc(doc_id) -> int:
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode())


def held_out(doc_id, mod: int = 10, rest: int = 0) -> bool:
    return _crc(doc_id) % mod == rest


def _differences(names: np.ndarray) -> bytes:
    return len(names).to_bytes(4, "little") + X.squeezed(X.pack(np.diff(names, prepend=np.uint64(0))))


def _summed_up(raw: bytes) -> np.ndarray:
    return np.cumsum(X.unpack(X.loosened(raw[4:]), int.from_bytes(raw[:4], "little")), dtype=np.uint64)


def _chunked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of CHUNK: runs of whole texts of a partition, tokenised; place 0 is a text's end, word i has place i + 1."""
    number = TaskContext.get().partitionId() << 32
    rest: list[pa.RecordBatch] = []
    size = 0

    def chunk(table: pa.Table) -> pa.RecordBatch:
        data, off = T.flat(table.column("text"))
        st, en, word_off = T.words(data, off)
        names, count, place = X.distinct(T.word_hashes(data, st, en, lower=True))
        order = np.argsort(-count, kind="stable")  # frequent words get short places; equally frequent ones stay sorted
        rank = np.empty(len(order), np.uint32)
        rank[order] = np.arange(1, len(order) + 1, dtype=np.uint32)
        ids = table.column("doc_id").to_pylist()
        crcs = np.fromiter(map(_crc, ids), np.uint32, len(ids)).tobytes()
        places = np.insert(rank[place], word_off[1:], 0)
        cols = [crcs, X.squeezed(X.pack(np.diff(word_off).astype(np.uint32))), _differences(names[order]), X.squeezed(X.pack(places))]
        ids = pa.array([ids], CHUNK_ARROW.field("ids").type)
        return pa.RecordBatch.from_arrays([pa.array([number]), ids, *(pa.array([c], pa.binary()) for c in cols)], schema=CHUNK_ARROW)

    for block in T.blocks(batches, "text", CHUNK_BYTES):
        own = block.column("text").nbytes
        if rest and size + own > CHUNK_BYTES:
            yield chunk(pa.Table.from_batches(rest))
            number, rest, size = number + 1, [], 0
        rest.append(block)
        size += own
    if rest:
        yield chunk(pa.Table.from_batches(rest))


class _Chunk:
    """Tokens of a chunk's documents and the distinct n-grams that end at them."""

    def __init__(self, table: pa.Table, name_bits: int, mod: int, rest: int, grams: bool = True):
        self.ids = table.column("ids")[0].values
        n = len(self.ids)
        lens = X.unpack(X.loosened(table.column("lens")[0].as_py()), n, np.uint32).astype(np.int64) + 1
        self.held = np.frombuffer(table.column("crcs")[0].as_py(), np.uint32) % mod == rest
        self.off = np.concatenate([[0], np.cumsum(lens)])
        # a chunk has fewer than 2**31 tokens, as a text has bytes
        which = X.unpack(X.loosened(table.column("places")[0].as_py()), int(self.off[-1]), np.uint32).view(np.int32)
        names = np.append(END, _summed_up(table.column("names")[0].as_py()))
        self.tokens = names[which]
        self.doc = np.repeat(np.arange(n, dtype=np.int32), lens)
        self.train = np.repeat(~self.held, lens)
        self.place = np.arange(len(which), dtype=np.int32)
        self.place -= np.repeat(self.off[:-1].astype(np.int32), lens)
        self.low = np.uint64(64 - name_bits)
        if not grams:
            return
        self.names, self.which = names, which
        words, _, rank = X.distinct(names)
        self.grams = [(np.arange(len(which), dtype=np.int32), words, rank.astype(np.int32)[which])]
        at = np.flatnonzero(self.place >= 1).astype(np.int32)
        before = np.uint64(0x9E3779B97F4A7C15) * T.mix(names + np.uint64(1))
        self.grams.append(self.gram(at, T.mix(self.tokens[at] + before[which[at - 1]])))

    def short(self, names: np.ndarray) -> np.ndarray:
        return names >> self.low << self.low

    def gram(self, at: np.ndarray, names: np.ndarray) -> tuple:
        """The places where n-grams end, the distinct names, and for each place the place of its name."""
        names, _, place = X.distinct(self.short(names))
        return at, names, place.astype(np.int32)

    def grow(self, pairs: np.ndarray) -> None:
        """Adds the triples whose context may be kept, by the global counts of pairs at every token."""
        t, first = self.tokens, np.uint64(3) * T.mix(self.names)
        at = np.flatnonzero(self.place >= 2).astype(np.int32)
        at = at[pairs[at - 1] >= LEAST_COUNT]
        self.grams.append(self.gram(at, T.mix(t[at] + np.uint64(0x9E3779B97F4A7C15) * T.mix(t[at - 1] + first[self.which[at - 2]]))))

    def extended(self, active: np.ndarray, order: int):
        """Of the tokens whose context of order - 1 words is kept, those with a longer one; the distinct n-grams'
        contexts (sorted) and next tokens (32 bits, as a context has few), and each token's place among them."""
        t, k = self.tokens, np.uint64(0x9E3779B97F4A7C15)
        at = active[self.place[active] >= order]
        context = np.zeros(len(at), np.uint64)
        for i in range(1, order + 1):
            context = T.mix(t[at - i] + k * (context + np.uint64(i)))
        context = self.short(context)
        names, _, place = X.distinct(T.mix(context ^ T.mix(t[at])))
        contexts, following = np.zeros(len(names), np.uint64), np.zeros(len(names), np.uint32)
        contexts[place], following[place] = context, t[at] >> np.uint64(32)
        by = X.ranks(contexts)
        rank = np.empty(len(by), np.int64)
        rank[by] = np.arange(len(by))
        return at, contexts[by], following[by], rank[place]

    def counts(self, order: int) -> np.ndarray:
        """Occurrences in the chunk's training texts of each distinct n-gram."""
        at, keys, place = self.grams[order]
        return np.bincount(place[self.train[at]], minlength=len(keys)).astype(np.uint32)

    def spread(self, order: int, totals: np.ndarray) -> np.ndarray:
        """Global counts at every token (0 where the n-gram would begin before the text)."""
        at, _, place = self.grams[order]
        if order == WORD:
            return totals[place].astype(float)
        out = np.zeros(len(self.tokens))
        out[at] = totals[place]
        return out


class _Model:
    """Probabilities at every token of a chunk from global counts."""

    def __init__(self, chunk: _Chunk, n: list[np.ndarray], size: int, vocabulary: int):
        self.n = n
        self.root = (n[0] + PRIOR) / (size + PRIOR * (vocabulary + 1))
        word, pair = np.roll(n[0], 1), np.zeros(len(chunk.tokens))
        word[chunk.off[:-1]] = 0
        grown = chunk.grams[2][0]
        pair[grown] = n[1][grown - 1]
        self.context = [None, word, pair]

    def next(self, order: int, at: np.ndarray, parent: np.ndarray, strength, left_out: bool = False) -> np.ndarray:
        """At the tokens ``at``; parent: the probabilities there."""
        held, total = self.counted(order, at, left_out)
        return (held + strength * parent) / (total + strength)

    def counted(self, order: int, at: np.ndarray, left_out: bool) -> tuple[np.ndarray, np.ndarray]:
        """Counts of the n-grams at the tokens ``at`` and of their contexts."""
        held, total = self.n[order][at], self.context[order][at]
        return (np.maximum(held - 1, 0), np.maximum(total - 1, 0)) if left_out else (held, total)


def _summed(vals: list[np.ndarray], place: np.ndarray, n: int) -> list[np.ndarray]:
    """Counts of equal keys together."""
    return [np.bincount(place, v, n).astype(np.uint64) for v in vals]


def _total(table: pa.Table, bits: int) -> pa.Table:
    """Bucket step: global counts of each chunk's n-grams; for words also a row (-1) with how many and how often."""
    chunk, keys, lens, counts = X.gathered(table)
    names, _, place = X.distinct(keys)
    (sums,) = _summed(counts, place, len(names))
    bucket = table.column("bucket")[0].as_py()
    found = X.replies(chunk, bucket, lens, [sums[place]])
    if bucket >> bits == WORD:
        found.append((-1, bucket, f"{int((sums > 0).sum())},{int(sums.sum())}".encode()))
    return X.rows(found, X.REPLY_ARROW)


def _signed(x: np.ndarray) -> np.ndarray:
    """Integers of either sign as unsigned ones, small for small."""
    return ((x << 1) ^ (x >> 63)).view(np.uint64)


def _unsigned(x: np.ndarray) -> np.ndarray:
    x = x.view(np.int64)
    return (x >> 1 & np.int64(2**63 - 1)) ^ -(x & 1)


def _gained(vals: list[np.ndarray], place: np.ndarray, n: int) -> list[np.ndarray]:
    """Left-out sums of equal contexts together."""
    return [_signed(np.bincount(place, _unsigned(v), n).astype(np.int64)) for v in vals]


def _decide(table: pa.Table, unit: float) -> pa.Table:
    """Bucket step: 0 for a context that isn't kept, else 1 + the place of its strength."""
    chunk, keys, lens, vals = X.gathered(table)
    names, _, place = X.distinct(keys)
    gains = np.array([_unsigned(g) * unit for g in _gained(vals, place, len(names))])
    choice = np.where(gains.max(axis=0) >= LEAST_GAIN, gains.argmax(axis=0) + 1, 0).astype(np.uint8)[place]
    return X.rows(X.replies(chunk, table.column("bucket")[0].as_py(), lens, [choice]), X.REPLY_ARROW)


def _decide_level(table: pa.Table, precision) -> pa.Table:
    """Bucket step of a level: for each n-gram of a chunk its context's decision, as _decide gives it, and for kept
    ones the counts of context and n-gram. A row (-1) says that a context is kept."""
    chunk, contexts, lens, (following, counts, parent) = X.gathered(table)
    parent = parent.view(precision).astype(np.float64)
    names, _, gram = X.distinct(T.mix(contexts ^ T.mix(following.astype(np.uint64))))
    _, _, context = X.distinct(contexts)
    n, total = np.bincount(gram, counts), np.bincount(context, counts)
    p, own = np.zeros(len(names)), np.zeros(len(names), np.int64)
    p[gram], own[gram] = parent, context
    gains = []
    for s in STRENGTHS:
        ratio = np.log((np.maximum(n - 1, 0) + s * p) / (np.maximum(total[own] - 1, 0) + s) / p)
        gains.append(np.bincount(own, n * ratio, len(total)))
    gains = np.array(gains)
    kept = (gains.max(axis=0) >= LEAST_GAIN) & (total >= LEAST_COUNT)
    choice = np.where(kept, gains.argmax(axis=0) + 1, 0).astype(np.uint8)[context]
    known = choice > 0
    arrays = [choice, np.where(known, total[context], 0).astype(np.uint64), np.where(known, n[gram], 0).astype(np.uint64)]
    bucket = table.column("bucket")[0].as_py()
    return X.rows(X.replies(chunk, bucket, lens, arrays) + ([(-1, bucket, b"")] if kept.any() else []), X.REPLY_ARROW)


def score_texts(docs: DataFrame, mod: int = 10, rest: int = 0, longest: int | None = None, exact: bool = False) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score (log10 of the text's probability).
    longest: words of a context at most, two or more; None grows the tree until no context pays. exact: names of
    64 bits, and sums and probabilities in messages without loss, at about twice the traffic."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    total = X.measure(docs)
    all_bits = X.bucket_bits(total // 8)
    bits = X.top(all_bits)
    name_bits = 64 if exact else min(64, math.ceil(math.log2(max(2, total // 6))) + 18)
    unit, precision = (EXACT_UNIT, EXACT_PARENT) if exact else (UNIT, PARENT)
    packed = written(docs.mapInArrow(_chunked, CHUNK))

    def load(table: pa.Table, grams: bool = True) -> _Chunk:
        return _Chunk(table, name_bits, mod, rest, grams)

    def send_words(table: pa.Table) -> pa.Table:
        c, chunk = load(table), table.column("chunk")[0].as_py()
        return X.rows([r for o in (WORD, PAIR) for r in X.send(chunk, c.grams[o][1], [c.counts(o)], bits, o)], X.SENT_ARROW)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):  # a chunk's arrays go before the next chunk is read
                yield from send_words(pa.Table.from_batches([batch.slice(i, 1)])).to_batches()

    def counted_at(c: _Chunk, replies: pa.Table, order: int) -> np.ndarray:
        got = X.answers(replies, c.grams[order][1], bits, order)
        return c.spread(order, got[0] if got else np.zeros(0, np.uint64))

    def totals(replies: pa.Table) -> list[int]:
        seen = replies.filter(pa.array([b == -1 for b in replies.column("bucket").to_pylist()]))
        return list(map(int, seen.column("reply")[0].as_py().split(b",")))

    def model(c: _Chunk, replies: pa.Table) -> _Model:
        n = [counted_at(c, replies, o) for o in (WORD, PAIR)]
        c.grow(n[PAIR])
        n.append(counted_at(c, replies, TRIPLE))
        c.grams[TRIPLE] = c.grams[TRIPLE][:1]  # only where they are is read again
        return _Model(c, n, *totals(replies))

    def contexts(c: _Chunk, m: _Model, order: int):
        """Tokens whose context of this order may be kept, and the place of the context's name."""
        at, _, place = c.grams[order - 1]
        named = np.full(len(c.tokens) + 1, -1, np.int32)
        named[at + 1] = place
        named = named[:-1]
        return np.flatnonzero(m.context[order] >= LEAST_COUNT), named

    def asked(c: _Chunk, m: _Model, order: int):
        """The tokens, their contexts' distinct names, and for each token the place of its context's name."""
        at, named = contexts(c, m, order)
        keys, named = c.grams[order - 1][1], named[at]
        used, place = np.zeros(len(keys), bool), np.zeros(len(keys), np.int32)
        used[named] = True
        names = c.short(keys[used])  # sorted, as the keys are
        new = np.diff(names, prepend=~names[:1]) != 0
        place[used] = np.cumsum(new) - 1
        return at, names[new], place[named]

    def gains(c: _Chunk, m: _Model, order: int, parent: np.ndarray, chunk: int) -> list[tuple]:
        """Rows with the left-out sums of contexts for each strength; parent: left-out probabilities in the parent."""
        at, keys, place = asked(c, m, order)
        use, sums = c.train[at], []
        at, place = at[use], place[use]
        parent = parent[at]
        held, total = m.counted(order, at, left_out=True)
        for s in STRENGTHS:
            ratio = np.log((held + s * parent) / (total + s) / parent)
            sums.append(_signed(np.rint(np.bincount(place, ratio, len(keys)) / unit).astype(np.int64)))
        return X.send(chunk, keys, sums, bits, 3 + order)

    def send_triples(table: pa.Table, replies: pa.Table) -> pa.Table:
        """Triples to count, and the sums of contexts of one word."""
        c, chunk = load(table), table.column("chunk")[0].as_py()
        n = [counted_at(c, replies, o) for o in (WORD, PAIR)]
        c.grow(n[PAIR])
        m = _Model(c, [*n, np.zeros(len(c.tokens))], *totals(replies))
        return X.rows(X.send(chunk, c.grams[TRIPLE][1], [c.counts(TRIPLE)], bits, TRIPLE) + gains(c, m, 1, m.root, chunk), X.SENT_ARROW)

    def send_gains(table: pa.Table, replies: pa.Table) -> pa.Table:
        c, chunk = load(table), table.column("chunk")[0].as_py()
        m = model(c, replies)
        q, _ = walked(c, m, replies, 1, left_out=True)
        return X.rows(gains(c, m, 2, q, chunk), X.SENT_ARROW)

    def walked(c: _Chunk, m: _Model, replies: pa.Table, deepest: int, left_out: bool = False):
        """For contexts of up to deepest words (two at most): probabilities at every token, with the token itself left
        out or not, and the choices."""
        p, strengths, choices = m.root.copy(), np.array([0.0, *STRENGTHS]), []
        for order in range(1, deepest + 1):
            at, keys, place = asked(c, m, order)
            got = X.answers(replies, keys, bits, 3 + order)
            choice = np.zeros(len(c.tokens), np.uint8)
            if got:
                choice[at] = got[0][place]
            kept = np.flatnonzero(choice)
            p[kept] = m.next(order, kept, p[kept], strengths[choice[kept]], left_out)
            choices.append(choice)
        return p, choices

    def settle(table: pa.Table, replies: pa.Table) -> pa.Table:
        """A chunk's sums over tokens that no longer context can change, and the counts at the others."""
        c, chunk = load(table), table.column("chunk")[0].as_py()
        m = model(c, replies)
        p, (one, two) = walked(c, m, replies, 2)
        n, active = len(c.ids), np.flatnonzero(two)
        still = two == 0
        sums = [np.bincount(c.doc, m.n[0] > 0, n), np.bincount(c.doc, np.log10(m.root), n), np.bincount(c.doc[still], np.log10(p[still]), n)]
        held = [m.n[0], m.n[1], m.n[2], m.context[1], m.context[2], one, two]
        raw = [np.array([*totals(replies), len(active)], np.int64).tobytes(), *(x.tobytes() for x in sums), X.pack(np.diff(active, prepend=0).astype(np.uint32)), *(X.pack(x[active].astype(np.uint32)) for x in held)]
        return X.rows([(chunk, SETTLED, b"".join(len(r).to_bytes(4, "little") + r for r in raw))], X.REPLY_ARROW)

    def settled(c: _Chunk, replies: pa.Table, deepest: int, left_out: bool = False):
        """Of a chunk: its totals and sums, and by the kept contexts of up to deepest words the probabilities at the
        tokens that were left open, with the token itself left out or not, and those whose context of deepest words
        is kept."""
        row = replies.column("bucket").to_pylist().index(SETTLED)
        head, *raw = X.parts(X.loosened(replies.column("reply")[row].as_py()))
        size, vocabulary, n = np.frombuffer(head, np.int64).tolist()
        at = np.cumsum(X.unpack(raw[3], n, np.uint32), dtype=np.int64)
        n0, n1, n2, c1, c2, one, two = (X.unpack(x, n, np.uint32) for x in raw[4:])
        strengths, less = np.array([0.0, *STRENGTHS]), 1.0 if left_out else 0.0

        def mixed(held: np.ndarray, total: np.ndarray, s: np.ndarray, parent: np.ndarray) -> np.ndarray:
            return (np.maximum(held - less, 0) + s * parent) / (np.maximum(total - less, 0) + s)

        open_p = (n0 + PRIOR) / (size + PRIOR * (vocabulary + 1))
        for held, total, choice in ((n1, c1, one), (n2, c2, two)):
            kept = np.flatnonzero(choice)
            open_p[kept] = mixed(held[kept], total[kept], strengths[choice[kept]], open_p[kept])
        p = np.zeros(len(c.tokens))
        p[at] = open_p
        active = at
        for order in range(3, deepest + 1):
            tried, keys, _, place = c.extended(active, order)
            got = X.answers(replies, keys, bits, 3 + order)
            own, total, held = (x[place] for x in got) if got else np.zeros((3, 0))
            kept = own > 0
            active = tried[kept]
            p[active] = mixed(held[kept], total[kept], strengths[own[kept].astype(int)], p[active])
        return size, [np.frombuffer(x) for x in raw[:3]], at, p, active

    def send_level(order: int):
        def run(table: pa.Table, replies: pa.Table) -> pa.Table:
            c, chunk = load(table, grams=False), table.column("chunk")[0].as_py()
            *_, q, active = settled(c, replies, order - 1, left_out=True)
            at, keys, following, place = c.extended(active, order)
            parent = np.zeros(len(keys), precision)
            parent[place] = q[at]
            held = np.bincount(place, c.train[at], len(keys)).astype(np.uint32)
            return X.rows(X.send(chunk, keys, [following, held, parent.view(f"u{parent.itemsize}")], bits, 3 + order), X.SENT_ARROW)

        return run

    def finish(table: pa.Table, replies: pa.Table, deepest: int) -> pa.Table:
        c = load(table, grams=False)
        size, (known, base, fixed), at, p, _ = settled(c, replies, deepest)
        n = len(c.ids)
        return pa.table(
            {
                "doc_id": c.ids,
                "held_out": pa.array(c.held),
                "n_tokens": pa.array(np.diff(c.off), pa.int64()),
                "n_known": pa.array(known.astype(np.int64)),
                "train_tokens": pa.array(np.full(n, size), pa.int64()),
                "base_score": pa.array(base),
                "score": pa.array(fixed + np.bincount(c.doc[at], np.log10(p[at]), n)),
            }
        )

    def judge(table: pa.Table) -> pa.Table:
        return _total(table, bits) if table.column("bucket")[0].as_py() >> bits <= TRIPLE else _decide(table, unit)

    def judge_level(table: pa.Table) -> pa.Table:
        return _decide_level(table, precision)

    merges = defaultdict(lambda: None, {WORD: _summed, PAIR: _summed, TRIPLE: _summed, 4: _gained, 5: _gained})

    def step(sent: DataFrame, decide) -> DataFrame:
        """The replies to what chunks send, written, so that a step's shuffles go when it is done."""
        return written(X.exchanged(sent, decide, all_bits, merges, notes=True))

    def asking(replies: DataFrame, send) -> DataFrame:
        return packed.groupBy("chunk").cogroup(replies.groupBy("chunk")).applyInArrow(send, X.SENT)

    counted = step(packed.mapInArrow(send, X.SENT), judge)
    pairs = F.split(F.decode("reply", "UTF-8"), ",")
    sums = counted.where("chunk = -1").agg(F.sum(pairs[1].cast("long")).alias("size"), F.sum(pairs[0].cast("long")).alias("vocabulary"))
    whole = sums.select(F.encode(F.concat_ws(",", F.coalesce("size", F.lit(0)), F.coalesce("vocabulary", F.lit(0))), "UTF-8"))
    chunks = packed.select("chunk", F.lit(-1).cast("long").alias("bucket"), whole.scalar().alias("reply"))
    replies = counted.where("chunk >= 0").union(chunks)
    early = [counted]
    for send_more in (send_triples, send_gains):
        early.append(step(asking(replies, send_more), judge))
        replies = replies.union(early[-1])
    replies, deepest = written(packed.groupBy("chunk").cogroup(replies.groupBy("chunk")).applyInArrow(settle, X.REPLY)), 2
    dropped(*early)
    while longest is None or deepest < longest:
        level = step(asking(replies, send_level(deepest + 1)), judge_level)
        if level.where("chunk = -1").isEmpty():
            break
        replies, deepest = replies.union(level.where("chunk >= 0")), deepest + 1

    def last(table: pa.Table, replies: pa.Table) -> pa.Table:
        return finish(table, replies, deepest)

    return packed.groupBy("chunk").cogroup(replies.groupBy("chunk")).applyInArrow(last, RESULT)
