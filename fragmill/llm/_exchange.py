"""Counting of many 64-bit keys across a corpus without a row per key.

Documents are dealt into chunks of a few MB. A chunk turns its keys into sorted distinct arrays, cuts
them by leading bits into buckets and sends one compact row per bucket (delta-coded, byte planes, compressed). A
bucket joins the arrays of all chunks and answers each chunk with one compact row about that chunk's own
keys. Every chunk sends a key at most once, however often it occurs there, so the load of a bucket
depends on distinct keys and chunks and never on how frequent a key is. The documents' shuffle by chunk
is planned alike everywhere, so Spark writes it once and reuses it.

Buckets hold about BUCKET_KEYS keys, so their number grows with the corpus; a chunk cuts by TOP_BITS at most. Beyond
that the messages of a bucket go to relays of about RELAY_KEYS keys, each of which merges equal keys of its chunks,
cuts the rest finer, and hands the answers back. So a chunk's messages never get smaller than its keys by 2 **
TOP_BITS, a relay's than RELAY_KEYS by the finer cut, and traffic grows in proportion to the keys.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CHUNK_BYTES = 2 << 20
BUCKET_KEYS = 1 << 20
RELAY_KEYS = 1 << 22
TOP_BITS = 11
SENT = "chunk long, bucket long, keys binary, vals binary"
REPLY = "chunk long, bucket long, reply binary"


def measure(docs: DataFrame, column: str = "text") -> int:
    """Bytes of text; one cheap aggregate over the column."""
    return int(docs.agg(F.sum(F.octet_length(column))).first()[0] or 0)


def dealt(docs: DataFrame, total: int, columns=("doc_id", "text"), chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """The given columns and ``chunk``: about chunk_bytes of text each, dealt by id and text together, so
    that neither a hot id nor a hot text fills a chunk."""
    n = max(1, math.ceil(total / chunk_bytes))
    return docs.select(*columns, F.pmod(F.xxhash64(*columns), F.lit(n)).alias("chunk"))


def bucket_bits(keys: int) -> int:
    return max(0, math.ceil(math.log2(max(1, keys) / BUCKET_KEYS)))


def pack(a: np.ndarray) -> bytes:
    """Unsigned integers as byte planes without the planes that are all zero."""
    some, size = int(np.bitwise_or.reduce(a)), a.dtype.itemsize
    used = [i for i in range(size) if some >> 8 * i & 255]
    planes = ((a >> a.dtype.type(8 * i) if i else a).astype(np.uint8).tobytes() for i in used)
    return bytes([sum(1 << i for i in used)]) + b"".join(planes)


def unpack(raw: bytes, n: int, dtype=np.uint64) -> np.ndarray:
    if raw[0] == 1:
        return np.frombuffer(raw, np.uint8, n, 1).astype(dtype)
    size = np.dtype(dtype).itemsize
    planes = np.zeros((n, size), np.uint8)
    at = 1
    for i in range(size):
        if raw[0] >> i & 1:
            planes[:, i] = np.frombuffer(raw, np.uint8, n, at)
            at += n
    return planes.reshape(-1).view(dtype)


def pack_keys(keys: np.ndarray) -> bytes:
    """Sorted keys by their differences, without the low bits that no key has."""
    used = int(np.bitwise_or.reduce(keys)) if len(keys) else 0
    low = (used & -used).bit_length() - 1 if used else 0
    return len(keys).to_bytes(4, "little") + bytes([low]) + pack(np.diff(keys >> np.uint64(low), prepend=np.uint64(0)))


def unpack_keys(raw: bytes) -> np.ndarray:
    return np.cumsum(unpack(raw[5:], int.from_bytes(raw[:4], "little")), dtype=np.uint64) << np.uint64(raw[4])


_zstd = pa.Codec("zstd", compression_level=1)


def squeezed(raw: bytes) -> bytes:
    return len(raw).to_bytes(4, "little") + _zstd.compress(raw, asbytes=True)


def loosened(raw: bytes) -> bytes:
    n = int.from_bytes(raw[:4], "little")
    return _zstd.decompress(raw[4:], n, asbytes=True) if n else b""


def cuts(keys: np.ndarray, bits: int, above: int = 0) -> np.ndarray:
    """Where the buckets begin in sorted keys, by ``bits`` bits below the first ``above``, which are all alike; 2**bits
    + 1 places."""
    if not bits or not len(keys):
        return np.append(np.zeros(1 << bits, np.int64), len(keys))
    head = keys[0] >> np.uint64(64 - above) << np.uint64(64 - above) if above else np.uint64(0)
    marks = head + (np.arange(1, 1 << bits, dtype=np.uint64) << np.uint64(64 - bits - above))
    return np.concatenate([[0], np.searchsorted(keys, marks), [len(keys)]])


def _ranked(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order that sorts the keys, and the sorted keys: plain sorting of their high bits with their places below,
    which is several times as fast as an argsort, and that where keys with equal high bits differ below. Keys without
    low bits there, as short names are, come out of the sorting itself."""
    bits = np.uint64(max(1, int(len(keys) - 1).bit_length()))
    low = (np.uint64(1) << bits) - np.uint64(1)
    short = not np.bitwise_or.reduce(keys) & low
    packed = keys | np.arange(len(keys), dtype=np.uint64) if short else keys & ~low | np.arange(len(keys), dtype=np.uint64)
    packed.sort()
    order = (packed & low).view(np.int64)
    if short:
        packed &= ~low
        return order, packed
    ranked = keys[order]
    if not (ranked[1:] >= ranked[:-1]).all():
        order = np.argsort(keys)
        ranked = keys[order]
    return order, ranked


def ranks(keys: np.ndarray) -> np.ndarray:
    """An order that sorts the keys."""
    return _ranked(keys)[0]


def distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted distinct keys, how often each occurs, and for each input key its place among them."""
    if not len(keys):
        return keys, np.zeros(0, np.int64), np.zeros(0, np.int64)
    order, ranked = _ranked(keys)
    new = np.empty(len(keys), bool)
    new[0] = False
    np.not_equal(ranked[1:], ranked[:-1], out=new[1:])
    place = np.empty(len(keys), np.int64)
    place[order] = np.cumsum(new)
    new[0] = True
    first = np.flatnonzero(new)
    return ranked[first], np.diff(first, append=len(keys)), place


def flags(x: np.ndarray) -> bytes:
    return np.packbits(x).tobytes()


def unflags(raw: bytes, n: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(raw, np.uint8), count=n).astype(bool)


def encode(v: np.ndarray) -> bytes:
    """Flags or unsigned integers with their kind."""
    return b"\0" + flags(v) if v.dtype == bool else bytes([v.dtype.itemsize]) + pack(v)


def decode(raw: bytes, n: int) -> np.ndarray:
    return unflags(raw[1:], n) if raw[0] == 0 else unpack(raw[1:], n, f"u{raw[0]}")


def bundle(arrays) -> bytes:
    return b"".join(len(r).to_bytes(4, "little") + r for r in map(encode, arrays))


def send(chunk: int, keys: np.ndarray, vals: list[np.ndarray], bits: int, kind: int = 0) -> list[tuple]:
    """Rows of SENT for sorted keys; vals: arrays beside them (bool or unsigned)."""
    at, out = cuts(keys, bits), []
    for b in np.flatnonzero(np.diff(at)):
        lo, hi = at[b], at[b + 1]
        out.append((chunk, (kind << bits) + int(b), pack_keys(keys[lo:hi]), bundle(v[lo:hi] for v in vals)))
    return out


def parts(raw: bytes) -> list[bytes]:
    out, at = [], 0
    while at < len(raw):
        n = int.from_bytes(raw[at : at + 4], "little")
        out.append(raw[at + 4 : at + 4 + n])
        at += 4 + n
    return out


SENT_ARROW = pa.schema([("chunk", pa.int64()), ("bucket", pa.int64()), ("keys", pa.binary()), ("vals", pa.binary())])
REPLY_ARROW = pa.schema([("chunk", pa.int64()), ("bucket", pa.int64()), ("reply", pa.binary())])


def rows(found: list[tuple], schema: pa.Schema) -> pa.Table:
    """Messages as rows, their content compressed; a row to no chunk (-1) stays as it is."""
    found = [r if r[0] < 0 else (*r[:2], *map(squeezed, r[2:])) for r in found]
    return pa.table([pa.array([r[i] for r in found], f.type) for i, f in enumerate(schema)], schema=schema)


def joined(messages: list[list[np.ndarray]]) -> list[np.ndarray]:
    return [np.concatenate(x) for x in zip(*messages)]


def gathered(table: pa.Table):
    """Of one bucket: chunk ids, keys of all chunks end to end, their lengths, and the vals end to end."""
    chunk = table.column("chunk").to_pylist()
    keys = [unpack_keys(loosened(x)) for x in table.column("keys").to_pylist()]
    vals = [[decode(p, len(k)) for p in parts(loosened(x))] for x, k in zip(table.column("vals").to_pylist(), keys)]
    return chunk, np.concatenate(keys) if keys else np.zeros(0, np.uint64), [len(k) for k in keys], joined(vals)


def replies(chunks: list[int], bucket: int, lens: list[int], arrays: list[np.ndarray]) -> list[tuple]:
    """Rows of REPLY: each chunk's part of arrays that run over the keys of all chunks."""
    at = np.concatenate([[0], np.cumsum(lens)])
    return [(c, bucket, bundle(x[at[i] : at[i + 1]] for x in arrays)) for i, c in enumerate(chunks)]


def repeated(table: pa.Table) -> pa.Table:
    """Bucket step: which keys of a chunk occur more than once in the corpus. vals: flags of keys that the
    chunk itself holds more than once."""
    chunk, keys, lens, (many,) = gathered(table)
    _, count, place = distinct(keys)
    hot = count > 1
    hot[place[many]] = True
    return rows(replies(chunk, table.column("bucket")[0].as_py(), lens, [hot[place]]), REPLY_ARROW)


def merged_flags(vals: list[np.ndarray], place: np.ndarray, n: int) -> list[np.ndarray]:
    """Merging for ``repeated``: a key that two chunks hold occurs more than once."""
    many = np.bincount(place, minlength=n) > 1
    many[place[vals[0]]] = True
    return [many]


def answers(table: pa.Table, keys: np.ndarray, bits: int, kind: int = 0, above: int = 0, column: str = "bucket") -> list[np.ndarray]:
    """Cogroup step: the reply arrays to one kind of a chunk's sorted keys, in the order of the keys; a bucket's reply
    covers the slice of the keys that went there. Without keys, none."""
    got = {b: r for b, r in zip(table.column(column).to_pylist(), table.column("reply").to_pylist())}
    at = cuts(keys, bits, above)
    return joined([[decode(p, int(at[b + 1] - at[b])) for p in parts(loosened(got[(kind << bits) + int(b)]))] for b in np.flatnonzero(np.diff(at))])


def answered_flags(table: pa.Table, keys: np.ndarray, bits: int, kind: int = 0) -> np.ndarray:
    got = answers(table, keys, bits, kind)
    return got[0] if got else np.zeros(0, bool)


def top(bits: int) -> int:
    """How many bits chunks cut by."""
    return min(bits, TOP_BITS)


RELAYED = "relay long, bucket long, sub long, keys binary, vals binary"
RELAYED_REPLY = "relay long, bucket long, sub long, reply binary"


def exchanged(sent: DataFrame, judge, bits: int, merges: dict, notes: bool = False) -> DataFrame:
    """REPLY rows to SENT rows. judge: the bucket step, table to table. merges: for each kind how to merge the vals of
    equal keys, or None where they must stay apart. notes: judge also makes rows to no chunk (-1)."""
    first = top(bits)
    if first == bits:
        return sent.groupBy("bucket").applyInArrow(judge, REPLY)
    finer = bits - first
    relays = max(1, (BUCKET_KEYS << finer) // RELAY_KEYS)
    sent = sent.withColumn("relay", F.pmod(F.xxhash64("chunk"), F.lit(relays)))

    def gather(table: pa.Table):
        chunk, keys, lens, vals = gathered(table)
        bucket = table.column("bucket")[0].as_py()
        merge = merges[bucket >> first]
        if merge is None:
            order = ranks(keys)
            place = np.empty(len(keys), np.int64)
            place[order] = np.arange(len(keys))
            return chunk, lens, bucket, keys[order], [v[order] for v in vals], place
        names, _, place = distinct(keys)
        return chunk, lens, bucket, names, merge(vals, place, len(names)), place

    def relay(table: pa.Table) -> pa.Table:
        _, _, bucket, keys, vals, _ = gather(table)
        own, at, out = table.column("relay")[0].as_py(), cuts(keys, finer, first), []
        for b in np.flatnonzero(np.diff(at)):
            lo, hi = at[b], at[b + 1]
            out.append((own, bucket, int(b), squeezed(pack_keys(keys[lo:hi])), squeezed(bundle(v[lo:hi] for v in vals))))
        return pa.table([pa.array([r[i] for r in out], pa.binary() if i > 2 else pa.int64()) for i in range(5)], names=["relay", "bucket", "sub", "keys", "vals"])

    def judge_finer(table: pa.Table) -> pa.Table:
        sub = table.column("sub")[0].as_py()
        got = judge(table.rename_columns({"relay": "chunk"}))
        return pa.table({"relay": got.column("chunk"), "bucket": got.column("bucket"), "sub": pa.array([sub] * got.num_rows, pa.int64()), "reply": got.column("reply")})

    def hand_back(table: pa.Table, got: pa.Table) -> pa.Table:
        chunk, lens, bucket, keys, _, place = gather(table)
        arrays = answers(got, keys, finer, 0, first, "sub")
        return rows(replies(chunk, bucket, lens, [x[place] for x in arrays]), REPLY_ARROW)

    found = sent.groupBy("bucket", "relay").applyInArrow(relay, RELAYED).groupBy("bucket", "sub").applyInArrow(judge_finer, RELAYED_REPLY)
    back = sent.groupBy("bucket", "relay").cogroup(found.where("relay >= 0").groupBy("bucket", "relay")).applyInArrow(hand_back, REPLY)
    return back.union(found.where("relay < 0").select(F.col("relay").alias("chunk"), "bucket", "reply")) if notes else back
