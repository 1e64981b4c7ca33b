"""MinHash near-dedup with tensored banding.

A document's set is its distinct 5-word shingles. Two collections of sub-keys are drawn, each sub-key from a
few minhashes; a table's key is the pair of one sub-key of each collection. r sub-keys a side give r * r
tables, so that r * r * 4 minhashes become 2 * r * 2. Documents that share a table's key are candidates, and
every link is confirmed on the full sets.

1. Equal sets collapse to one class, named by a hash of the set; its text is that of the smallest doc_id.
2. Sub-keys that nobody shares are dropped before tables are formed: no table with them can match.
3. In each table every member is compared with one centre, the member whose sub-keys are the most common; so
   a group of n near copies costs about n comparisons, not n * n. Confirmed links give components.
4. Members of a group that are still apart are compared with all others of the group, in blocks of bounded
   size: first by sketch, then by sets. Only confirmed links leave a block, one for each member and
   component. Blocks make this step exact for the rest without a cap on partners.
5. A group of more than a block is not compared as a whole (pages with common boilerplate share sub-keys without
   being alike). Its members meet by the prefix filter instead: in any fixed order of shingles, sets alike to t
   share one of the first n - ceil(t * n) + 1. The order is by how often a shingle occurs among these members (in
   a table of CELLS counts), so that boilerplate comes last and members meet by what is rare.

The number of sub-keys a side follows from the least similarity, so that a pair is missed with probability 2e-5 at
most: nine at 0.85, twelve at 0.80.

Defined results: null or empty texts have no shingles and link with nothing; a text under five words is one
shingle; repeated rows are copies of each other; a row without doc_id is a component of its own (null);
an id that names several texts is judged row by row, each by its own text, and kept is doc_id = component_id of the
row. Sets are named by 64 bits where they link (one in 2**64 / classes is misnamed). An empty table gives an empty
result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fragmill.llm import _text as T
from fragmill.llm._tables import components, dropped, unused, written

HASHES = 2
MOST_MISSED, MOST_UNLIKE = 2e-5, 1e-5
BLOCK = 512
CELLS = 1 << 18
SIGNATURE = "doc_id long, text_hash long, n_shingles long, set_lo long, set_hi long, subkeys array<long>, sketch binary"


@lru_cache
def drawn(percent: int) -> tuple[int, int]:
    """Sub-keys a side that miss a pair at percent with probability MOST_MISSED at most, and the least number of
    agreeing minhashes, which such a pair falls below with probability MOST_UNLIKE at most."""
    p, side = percent / 100, 1
    while 1 - (1 - (1 - p**HASHES) ** side) ** 2 > MOST_MISSED:
        side += 1
    n, least, below = 2 * side * HASHES, 0, 0.0
    while least < n and (below := below + math.comb(n, least) * p**least * (1 - p) ** (n - least)) <= MOST_UNLIKE:
        least += 1
    return side, least


def shingle_sets(column, k: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """All documents' distinct shingle hashes end to end (sorted within a document), and the offsets."""
    data, off = T.flat(column)
    st, en, word_off = T.words(data, off)
    hashes = T.word_hashes(data, st, en, lower=True)
    keys, at = T.windows(hashes, word_off, k)
    lens = np.diff(word_off)
    short = np.flatnonzero((lens > 0) & (lens < k))
    prefix = T.prefix_sums(hashes)
    whole = T.mix(T.span_hashes(prefix, word_off[short], word_off[short + 1]) ^ T.mix(lens[short].astype(np.uint64)))
    key_off = np.searchsorted(at, word_off)
    out, sizes, shorts = [], np.zeros(len(off) - 1, np.int64), dict(zip(short.tolist(), whole))
    for i, (a, b) in enumerate(zip(key_off[:-1].tolist(), key_off[1:].tolist())):
        if b > a:
            got = np.sort(keys[a:b])
            got = got[np.concatenate([[True], got[1:] != got[:-1]])]
        elif i in shorts:
            got = np.array([shorts[i]], np.uint64)
        else:
            continue
        out.append(got)
        sizes[i] = len(got)
    return (np.concatenate(out) if out else np.zeros(0, np.uint64)), np.concatenate([[0], np.cumsum(sizes)])


def minhashes(keys: np.ndarray, off: np.ndarray, number: int) -> np.ndarray:
    """One row of so many minhashes (32 bits) for each set that isn't empty."""
    multipliers = np.random.default_rng(0xB0B).integers(0, 2**63, number, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    start = off[:-1][np.diff(off) > 0]
    out = np.empty((len(start), number), np.uint32)
    if len(start):
        for i, m in enumerate(multipliers):
            v = keys * m
            v ^= v >> np.uint64(29)
            v *= np.uint64(0xBF58476D1CE4E5B9)
            out[:, i] = np.minimum.reduceat((v >> np.uint64(32)).astype(np.uint32), start)
    return out


def _signatures(k: int, side: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in T.blocks(batches):
            keys, off = shingle_sets(block.column("text"), k)
            sizes = np.diff(off)
            full = sizes > 0
            lo, hi = np.zeros(len(sizes), np.uint64), np.zeros(len(sizes), np.uint64)
            if full.any():
                start = off[:-1][full]
                lo[full] = np.add.reduceat(T.mix(keys), start)
                hi[full] = np.add.reduceat(T.mix(keys ^ np.uint64(0xA5A5A5A5A5A5A5A5)), start)
            mins = minhashes(keys, off, 2 * side * HASHES)
            which = np.arange(2 * side, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
            sub = T.mix(mins[:, 0::2].astype(np.uint64) << np.uint64(32) | mins[:, 1::2]) ^ T.mix(which)
            place = np.cumsum(full) - 1
            yield pa.RecordBatch.from_arrays(
                [
                    block.column("doc_id"),
                    block.column("text_hash"),
                    pa.array(sizes, pa.int64()),
                    pa.array(lo.view(np.int64)),
                    pa.array(hi.view(np.int64)),
                    pa.array([sub[place[i]].view(np.int64) if full[i] else None for i in range(len(sizes))], pa.list_(pa.int64())),
                    pa.array([mins[place[i]].tobytes() if full[i] else None for i in range(len(sizes))], pa.binary()),
                ],
                names=[x.split()[0] for x in SIGNATURE.split(", ")],
            )

    return run


def _sets(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in T.blocks(batches):
            keys, off = shingle_sets(block.column("text"), k)
            yield pa.RecordBatch.from_arrays([block.column("rep"), pa.array([keys[a:b].tobytes() for a, b in zip(off[:-1], off[1:])], pa.binary())], names=["rep", "keys"])

    return run


def _confirmed(percent: int):
    """Keeps the pairs (a, b, keys_a, keys_b) whose sets are alike enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("keys_a"), batch.column("keys_b")):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * both >= percent * (len(x) + len(y) - both))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def _agree(x: str, y: str, number: int):
    """SQL: how many minhashes of two sketches are equal; cheap next to fetching the sets."""
    return F.expr(f"size(filter(sequence(0, {number - 1}), i -> substring({x}, 4 * i + 1, 4) = substring({y}, 4 * i + 1, 4)))")


def _grouped(batches: Iterator[pa.RecordBatch], key: str):
    """Whole groups of rows with equal key from batches sorted by it."""
    rest: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = batch.column(key).to_numpy()
        edges = np.flatnonzero(np.diff(keys)) + 1
        if rest and rest[0].column(key)[0].as_py() != keys[0]:
            yield pa.Table.from_batches(rest)
            rest = []
        at = 0
        for e in edges.tolist():
            yield pa.Table.from_batches([*rest, batch.slice(at, e - at)])
            rest, at = [], e
        rest.append(batch.slice(at))
    if rest:
        yield pa.Table.from_batches(rest)


def _open_pairs(t: pa.Table, percent: int):
    """Of a block: left and right rows, and which pairs of them may still link (left row apart from right)."""
    side, least = drawn(percent)
    left = np.flatnonzero(t.column("lone").to_numpy())
    right = np.flatnonzero(~t.column("lone").to_numpy())
    sketch = np.frombuffer(b"".join(t.column("sketch").to_pylist()), np.uint32).reshape(-1, 2 * side * HASHES)
    comp, size = t.column("component").to_numpy(), t.column("n").to_numpy()
    may = np.zeros((len(left), len(right)), bool)
    c = max(t.column("g")[0].as_py(), 0)  # pairs that agree on an earlier sub-key have met there
    for i, x in enumerate(left):
        same = sketch[right] == sketch[x]
        pairs = same[:, : side * HASHES].reshape(len(right), side, HASHES).all(axis=2)
        fits = 100 * np.minimum(size[right], size[x]) >= percent * np.maximum(size[right], size[x])
        may[i] = (same.sum(axis=1) >= least) & ~pairs[:, :c].any(axis=1) & fits & (comp[right] != comp[x])
    return left, right, may, comp


def _still_open(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _grouped(batches, "block"):
            left, right, may, _ = _open_pairs(t, percent)
            keep = np.concatenate([left[may.any(axis=1)], right[may.any(axis=0)]])
            if len(keep):
                yield from t.take(pa.array(np.sort(keep))).combine_chunks().to_batches()

    return run


def _block_links(percent: int):
    """Confirmed links of a block, for each left row one to each component."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _grouped(batches, "block"):
            left, right, may, comp = _open_pairs(t, percent)
            if not may.any():
                continue
            raw, rep = t.column("keys").to_pylist(), t.column("rep").to_numpy()
            sets = [np.frombuffer(x, np.uint64) for x in raw]
            size = np.array([len(s) for s in sets])
            flat = np.concatenate([sets[j] for j in right])
            start = np.concatenate([[0], np.cumsum(size[right])[:-1]])
            found = []
            for i, x in enumerate(left):
                own = sets[x]
                at = np.minimum(np.searchsorted(own, flat), len(own) - 1)
                both = np.add.reduceat((own[at] == flat).astype(np.int64), start)
                ok = may[i] & (100 * both >= percent * (size[right] + size[x] - both))
                hits = right[ok]
                if len(hits):
                    _, first = np.unique(comp[hits], return_index=True)
                    found += [(rep[x], rep[j]) for j in hits[first]]
            if found:
                yield pa.RecordBatch.from_arrays([pa.array([int(f[0]) for f in found]), pa.array([int(f[1]) for f in found])], names=["a", "b"])

    return run


def _cells(keys: np.ndarray) -> np.ndarray:
    return (T.mix(keys) >> np.uint64(64 - CELLS.bit_length() + 1)).astype(np.int64)


def _cell_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held = np.zeros(CELLS, np.int64)
    for batch in batches:
        for x in batch.column("keys"):
            held += np.bincount(_cells(np.frombuffer(x.as_buffer(), np.uint64)), minlength=CELLS)
    at = np.flatnonzero(held)
    yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(held[at])], names=["cell", "held"])


def _prefixes(held: np.ndarray, percent: int):
    """(rep, key): of each set the shingles of which sets alike to percent share one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, x in enumerate(batch.column("keys")):
                keys = np.frombuffer(x.as_buffer(), np.uint64)
                first = len(keys) + (-percent * len(keys) // 100) + 1
                keys = keys[np.lexsort((keys, held[_cells(keys)]))[:first]]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(keys), batch.column("rep")[i].as_py())), pa.array(keys.view(np.int64))], names=["rep", "key"])

    return run


def _split_groups(members: DataFrame) -> DataFrame:
    """Groups (g, key) whose members (rep, pop, component) are in several components; main: the commonest member's."""
    groups = members.groupBy("g", "key").agg(F.count("*").alias("held"), F.min("component").alias("lo"), F.max("component").alias("hi"), F.max(F.struct("pop", "component")).alias("top"))
    return groups.where("lo <> hi").select("g", "key", "held", F.col("top.component").alias("main"))


def _blocks(members: DataFrame, groups: DataFrame) -> DataFrame:
    """Rows (block, lone) of the groups' members, such that each member outside the main component meets every other
    member of its group in one block of at most about BLOCK rows a side."""
    apart = members.join(groups, ["g", "key"])
    lones = apart.where("component <> main").groupBy("g", "key").agg(F.count("*").alias("lones"))
    apart = apart.join(lones, ["g", "key"]).withColumn("nb", F.ceil(F.col("held") / BLOCK)).withColumn("nl", F.ceil(F.col("lones") / BLOCK))
    own = F.xxhash64("rep")
    every = apart.withColumn("lb", F.explode(F.sequence(F.lit(0), F.col("nl") - 1))).withColumn("ab", F.pmod(own, "nb")).withColumn("lone", F.lit(False))
    single = apart.where("component <> main").withColumn("ab", F.explode(F.sequence(F.lit(0), F.col("nb") - 1))).withColumn("lb", F.pmod(own, "nl")).withColumn("lone", F.lit(True))
    split = [x.select(F.xxhash64("g", "key", F.col("lb").cast("long"), F.col("ab").cast("long")).alias("block"), "lone", "g", "rep", "component") for x in (every, single)]
    return split[0].union(split[1])


def _links(docs: DataFrame, reps: DataFrame, k: int, percent: int) -> DataFrame:
    """Links (a, b) between classes that connect all pairs alike enough."""
    side, least = drawn(percent)
    subkeys = reps.select("rep", F.posexplode("subkeys").alias("g", "key"))
    shared = subkeys.groupBy("g", "key").agg(F.count("*").alias("held")).where("held > 1")
    active = written(subkeys.join(shared, ["g", "key"]))
    popular = active.groupBy("rep").agg(F.sum("held").alias("pop"), F.collect_list(F.struct("g", "key")).alias("own"))
    popular = written(popular.join(reps.select("rep", "n", "sketch", "doc_id", "text_hash"), "rep"))
    tables = popular.select("rep", "pop", F.explode(F.filter("own", lambda s: s.g < side)).alias("x"), "own")
    tables = tables.select("rep", "pop", "x", F.explode(F.filter("own", lambda s: s.g >= side)).alias("y"))
    tables = tables.select("rep", "pop", F.xxhash64("x.g", "x.key", "y.g", "y.key").alias("table"))
    centres = tables.groupBy("table").agg(F.count("*").alias("held"), F.max(F.struct("pop", "rep")).alias("top"))
    centres = centres.where("held > 1").select("table", F.col("top.rep").alias("centre"))
    pairs = tables.join(centres, "table").where("rep <> centre").select(F.least("rep", "centre").alias("a"), F.greatest("rep", "centre").alias("b")).distinct()
    one = popular.select(F.col("rep").alias("a"), F.col("n").alias("na"), F.col("sketch").alias("sa"))
    two = popular.select(F.col("rep").alias("b"), F.col("n").alias("nb"), F.col("sketch").alias("sb"))
    pairs = pairs.join(one, "a").join(two, "b").where(f"100 * least(na, nb) >= {percent} * greatest(na, nb)")
    pairs = written(pairs.where(_agree("sa", "sb", 2 * side * HASHES) >= least).select("a", "b"))

    # one shuffle of the texts serves both confirmations; the hint keeps the plan the same at every size
    chosen = popular.select("rep", "doc_id", "text_hash").hint("shuffle_merge")
    texts = docs.join(chosen, ["doc_id", "text_hash"]).dropDuplicates(["doc_id", "text_hash"])
    keys = written(texts.select("rep", "text").mapInArrow(_sets(k), "rep long, keys binary"))
    first = pairs.join(keys.toDF("a", "keys_a"), "a").join(keys.toDF("b", "keys_b"), "b")
    first = written(first.select("a", "b", "keys_a", "keys_b").mapInArrow(_confirmed(percent), "a long, b long"))

    # what is still apart within a group of one sub-key
    labels = components(first)
    members = active.where(F.col("g") < side).join(popular.select("rep", "pop"), "rep")
    members = members.join(labels.withColumnRenamed("node", "rep"), "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    members = written(members.select("g", "key", "rep", "pop", "component"))
    groups = written(_split_groups(members))
    blocks = _blocks(members, groups.where(F.col("held") <= BLOCK))
    many = written(members.join(groups.where(F.col("held") > BLOCK), ["g", "key"], "left_semi").select("rep", "pop", "component").dropDuplicates(["rep"]))
    if not many.isEmpty():
        sets = written(keys.join(many.select("rep"), "rep"))
        counts = sets.mapInArrow(_cell_counts, "cell long, held long").groupBy("cell").agg(F.sum("held").alias("held")).toArrow()  # CELLS rows at most
        held = np.zeros(CELLS, np.int64)
        held[counts.column("cell").to_numpy()] = counts.column("held").to_numpy()
        met = sets.mapInArrow(_prefixes(held, percent), "rep long, key long").join(many, "rep")
        met = written(met.select(F.lit(-1).alias("g"), "key", "rep", "pop", "component"))
        blocks = blocks.union(_blocks(met, _split_groups(met)))
    schema = "block long, lone boolean, g int, rep long, n long, sketch binary, component long"
    blocks = blocks.join(popular.select("rep", "n", "sketch"), "rep").select(*(x.split()[0] for x in schema.split(", ")))
    opened = written(blocks.repartition("block").sortWithinPartitions("block").mapInArrow(_still_open(percent), schema))
    second = opened.join(keys, "rep").select("block", "lone", "g", "rep", "n", "sketch", "component", "keys").repartition("block").sortWithinPartitions("block")
    second = written(second.mapInArrow(_block_links(percent), "a long, b long"))
    dropped(active, popular, pairs, keys, members, groups, many, opened)
    return first.union(second)


def near_duplicates(docs: DataFrame, percent: int = 85, k: int = 5, with_class: bool = False) -> DataFrame:
    """doc_id, n_shingles, component_id, kept: documents linked at 100 * intersection >= percent * union; with_class also
    text_hash (xxhash64 of the text) and class, which is one for all texts of a component (null without shingles or id)."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    docs = docs.withColumn("text_hash", F.xxhash64("text"))
    marks = written(docs.mapInArrow(_signatures(k, drawn(percent)[0]), SIGNATURE))
    full = marks.where("n_shingles > 0 and doc_id is not null")
    reps = full.groupBy("set_lo", "set_hi").agg(F.min(F.struct("doc_id", "text_hash")).alias("least"), F.first("subkeys").alias("subkeys"), F.first("sketch").alias("sketch"), F.first("n_shingles").alias("n"))
    reps = written(reps.select(F.xxhash64("set_lo", "set_hi").alias("rep"), "set_lo", "set_hi", "least.doc_id", "least.text_hash", "subkeys", "sketch", "n"))
    labels = components(_links(docs, reps, k, percent)).withColumnRenamed("node", "rep")
    classes = reps.select("set_lo", "set_hi", "rep", "doc_id").join(labels, "rep", "left").withColumn("class", F.coalesce("component", "rep"))
    least = classes.groupBy("class").agg(F.min("doc_id").alias("component_id"))
    classes = classes.join(least, "class").select("set_lo", "set_hi", "class", "component_id")
    out = marks.select("doc_id", "text_hash", "n_shingles", "set_lo", "set_hi").join(classes, ["set_lo", "set_hi"], "left")
    linked = (F.col("n_shingles") > 0) & F.col("doc_id").isNotNull()
    own = F.when(linked, F.col("component_id")).otherwise(F.col("doc_id"))
    more = ["text_hash", F.when(linked, F.col("class")).alias("class")] if with_class else []
    return out.select("doc_id", "n_shingles", own.alias("component_id"), F.col("doc_id").eqNullSafe(own).alias("kept"), *more)


def without_near_duplicates(docs: DataFrame, percent: int = 80) -> DataFrame:
    """Of each class of near duplicates one row, all columns: the one with the smallest doc_id (of its texts the least
    hash). Rows without shingles or id stay, but rows equal in id and text stay once."""
    found = near_duplicates(docs, percent, with_class=True)
    counts = found.groupBy("doc_id", "text_hash").agg(F.count("*").alias("copies"), F.min("class").alias("class"))
    alone = F.when(F.col("class").isNull(), F.struct("doc_id", "text_hash"))
    one = counts.groupBy("class", alone.alias("alone")).agg(F.min(F.struct("doc_id", "text_hash", "copies")).alias("x")).select("x.*")
    names = [unused(docs, c) for c in one.columns]
    one = one.toDF(*names)
    same = docs["doc_id"].cast("long").eqNullSafe(one[names[0]]) & (F.xxhash64(docs["text"].cast("string")) == one[names[1]])
    kept = docs.join(one, same).select(*(docs[c] for c in docs.columns), names[2])
    again = kept.where(F.col(names[2]) > 1).drop(names[2]).dropDuplicates(["doc_id", "text"])
    return kept.where(F.col(names[2]) == 1).drop(names[2]).union(again)
