"""Vectorised text kernels shared by the operators: words, rolling hashes, slicing of Arrow batches.

Texts are handled as one flat byte array with document offsets, so that all work per byte is done by
numpy. Words are named by a chain of non-linear steps over blocks of eight bytes (a sum of powers modulo 2**64
would give some unlike words of regular spelling the same name); long words by BLAKE2b. Hashes of windows are
polynomial (Rabin-Karp) sums modulo 2**64 over these names, rolled by differences of prefix sums.
"""

from __future__ import annotations

from hashlib import blake2b

import numpy as np
import pyarrow as pa

WHITE = np.zeros(256, bool)
WHITE[[0x20, 9, 10, 11, 12, 13]] = True
_rng = np.random.default_rng(0x5EED)
BYTE_VALUES = _rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
BLOCK_BYTES = 1 << 20
LONG_WORD = 64
BASE = 0x9E3779B97F4A7C15
_powers: dict[int, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit values (splitmix64)."""
    x = x + np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def powers(n: int, base: int = BASE) -> np.ndarray:
    """base ** 0 ... base ** (n - 1) modulo 2**64."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = max(n, 1 << 16) * 5 // 4
        have = np.full(size, base, np.uint64)
        have[0] = 1
        _powers[base] = have = np.cumprod(have, dtype=np.uint64)
    return have[:n]


def inverse(base: int = BASE) -> int:
    return pow(base, -1, 1 << 64)


def prefix_sums(values: np.ndarray, base: int = BASE) -> np.ndarray:
    out = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * powers(len(values), base), out=out[1:])
    return out


def span_hashes(prefix: np.ndarray, start: np.ndarray, end: np.ndarray, base: int = BASE) -> np.ndarray:
    """Position-free hashes of the spans [start, end)."""
    return (prefix[end] - prefix[start]) * powers(len(prefix), inverse(base))[start]


def flat(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column and its n + 1 offsets; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    if isinstance(column, pa.ChunkedArray):
        column = column.chunk(0) if column.num_chunks else pa.array([], pa.string())
    column = column.cast(pa.large_string()) if column.type != pa.large_string() else column
    column = column.fill_null("")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


def blocks(batches, column: str = "text", limit: int = BLOCK_BYTES):
    """Cuts Arrow batches into runs of whole rows with about ``limit`` bytes of text each.

    A text longer than that makes a block of its own; no text is cut."""
    for batch in batches:
        if not batch.num_rows:
            continue
        _, off = flat(batch.column(batch.schema.get_field_index(column)))
        at = 0
        while at < batch.num_rows:
            to = int(np.searchsorted(off, off[at] + limit, "right")) - 1
            to = min(max(to, at + 1), batch.num_rows)
            yield batch.slice(at, to - at)
            at = to


def words(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words [^\\x20\\x09-\\x0D]+, and the n + 1 word offsets of the documents."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(off), np.int64)
    solid = ~WHITE[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[off] = True
    start = solid.copy()
    start[1:] &= ~solid[:-1] | edge[1:-1]
    end = solid
    end[:-1] &= WHITE[data[1:]] | edge[1:-1]
    st, en = np.flatnonzero(start), np.flatnonzero(end) + 1
    return st, en, np.searchsorted(st, off)


def span_names(data: np.ndarray, st: np.ndarray, en: np.ndarray) -> np.ndarray:
    """64-bit names of the byte strings [st, en)."""
    size = en - st
    out = mix(size.astype(np.uint64))
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    eight = np.ndarray(len(data) + 1, "<u8", padded, 0, (1,))  # the eight bytes from each place on
    live = np.flatnonzero((size > 0) & (size <= LONG_WORD))
    at, left = st[live], size[live]
    while len(live):
        block = eight[at] & (~np.uint64(0) >> (np.uint64(64) - np.minimum(left, 8).astype(np.uint64) * np.uint64(8)))
        out[live] = mix(out[live] ^ block)
        more = left > 8
        live, at, left = live[more], at[more] + 8, left[more] - 8
    for i in np.flatnonzero(size > LONG_WORD).tolist():
        out[i] = int.from_bytes(blake2b(data[st[i] : en[i]], digest_size=8).digest(), "little")
    return out


def word_hashes(data: np.ndarray, st: np.ndarray, en: np.ndarray, lower: bool = False) -> np.ndarray:
    return span_names(LOWER[data] if lower else data, st, en)


def windows(hashes: np.ndarray, word_off: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Rabin-Karp hashes of every k consecutive words of one document, and the word each starts at."""
    n = len(hashes)
    if n < k:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    prefix = prefix_sums(hashes)
    rolled = mix((prefix[k:] - prefix[:-k]) * powers(n + 1, inverse())[: n - k + 1])
    valid = np.zeros(n + 1, np.int32)
    lens = np.diff(word_off)
    has = lens >= k
    np.add.at(valid, word_off[:-1][has], 1)
    np.add.at(valid, word_off[1:][has] - k + 1, -1)
    at = np.flatnonzero(np.cumsum(valid[: n - k + 1]) > 0)
    return rolled[at], at


def covered(starts: np.ndarray, width: int, n: int) -> np.ndarray:
    """Which of n places lie in [s, s + width) for some start s."""
    step = np.zeros(n + 1, np.int32)
    np.add.at(step, starts, 1)
    np.add.at(step, np.minimum(starts + width, n), -1)
    return np.cumsum(step[:n]) > 0
