"""Document fingerprints: invertible Bloom lookup sketches of paragraph digests, in SQL functions alone.

A text is cut at line ends and after punctuation; the distinct pieces' digests enter a sketch of cells
(count, xor of digests, xor of check sums), each digest in one cell of each of three tables. Equal texts have
equal sketches. Two sketches subtract cell by cell; cells with one digest left are peeled until nothing is
left, which recovers exactly the digests that differ. If that fails, the sketch is retried larger: as
sub-sketches by digest, each sized for its share, a failing one again with twice the cells and other
positions. What is still undecided then (about once in a billion sub-sketches) is compared directly.
Likeness is 2 * common / (digests of one + digests of the other); 1 for two texts without digests.

The next document in descending doc_id comes from a window within ranges of ids of about equal size; an id (or the
lack of one) that would fill several ranges is cut by its texts' hashes. The first row of each range is also dealt to the
range before it, so that one shuffle of the texts is enough and no window covers the whole table.

Defined results: null counts as empty text; rows without doc_id come last; rows that share an id follow
each other in the order of their texts' hash; a single row is followed by itself.
"""

from __future__ import annotations

import math
from collections import Counter
from itertools import accumulate

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

WIDTH = 8  # cells of each of the three tables of a fingerprint
SUB_KEYS, SUB_WIDTH = 4, 4  # digests (of both texts) a sub-sketch is made for, and its first width
ROUNDS = 16
RANGE_BYTES = 2 << 20
CHECK = 77
ZERO = "named_struct('n', 0L, 'x', 0L, 'h', 0L)"
NOTHING = "cast(array() as array<bigint>)"
RETRIES = ((101, SUB_WIDTH), (102, 2 * SUB_WIDTH), (103, 5 * SUB_WIDTH), (104, 5 * SUB_WIDTH))


def digests(text: str) -> str:
    """SQL: distinct digests of the pieces of a text."""
    cut = r"\\n|(?<=[.;:!?])\\s+"
    return f"array_distinct(transform(filter(split({text}, '{cut}'), s -> length(trim(s)) > 0), s -> xxhash64(s)))"


def _places(key: str, salt: int, w: int) -> str:
    """SQL: the three cells, of 3 * w (at most 62), of a key as the bits of a number."""
    bits = " | ".join(f"shiftleft(1L, cast({j * w} + pmod(shiftright(y, {20 * j}), {w}) as int))" for j in range(3))
    return f"transform(array(xxhash64({key}, {salt})), y -> {bits})[0]"


def _has(places: str, i: str) -> str:
    return f"(shiftright({places}, cast({i} as int)) & 1L) = 1L"


def placed(keys: str, w: int, salt: int, sign: int = 1) -> str:
    """SQL: signed keys with their cells and check sum."""
    return f"transform({keys}, k -> named_struct('n', {sign}L, 'x', k, 'p', {_places('k', salt, w)}, 'h', xxhash64(k, {CHECK})))"


def cells(keys: str, w: int) -> str:
    """SQL: the sketch of placed keys."""
    add = "(a, q) -> named_struct('n', a.n + q.n, 'x', a.x ^ q.x, 'h', a.h ^ q.h)"
    # named inside, so that the optimiser can't move the keys' expression into the loop over cells
    return f"transform(array({keys}), z -> transform(sequence(0, {3 * w - 1}), i -> aggregate(filter(z, q -> {_has('q.p', 'i')}), {ZERO}, {add})))[0]"


def peeled(difference: str, w: int, salt: int) -> str:
    """SQL: struct(cells, found, done) of a difference of sketches after peeling; found: recovered digests."""
    # a key alone in several cells is taken once; cells that don't change are kept as they are
    pure = f"array_distinct(transform(filter(s.cells, c -> abs(c.n) = 1 and xxhash64(c.x, {CHECK}) = c.h), c -> named_struct('n', c.n, 'x', c.x, 'p', {_places('c.x', salt, w)}, 'h', c.h)))"
    take = f"(a, q) -> named_struct('n', a.n - q.n, 'x', a.x ^ q.x, 'h', a.h ^ q.h)"
    left = f"transform(s.cells, (c, i) -> aggregate(filter(p, q -> {_has('q.p', 'i')}), c, {take}))"
    step = f"element_at(transform(array({pure}), p -> named_struct('cells', if(size(p) = 0, s.cells, {left}), 'found', concat(s.found, transform(p, q -> q.x)), 'done', size(p) = 0)), 1)"
    return f"aggregate(sequence(1, {ROUNDS}), named_struct('cells', {difference}, 'found', {NOTHING}, 'done', false), (s, r) -> if(s.done, s, {step}))"


def _empty(peel: str) -> str:
    return f"forall({peel}.cells, c -> c.n = 0 and c.x = 0 and c.h = 0)"


def with_likeness(df: DataFrame, fa: str, a: str, fb: str, b: str, out: str) -> DataFrame:
    """Adds the likeness of two texts from their sketches (fa, fb) and, for larger sketches, their digests."""
    have = df.columns
    df = df.withColumn("peel", F.expr(peeled(f"zip_with({fa}, {fb}, (u, v) -> named_struct('n', u.n - v.n, 'x', u.x ^ v.x, 'h', u.h ^ v.h))", WIDTH, 1)))
    df = df.withColumn("side", F.expr(f"if({_empty('peel')}, 0, cast(ceil(sqrt((size({a}) + size({b})) / {SUB_KEYS}.0)) as int))"))
    df = df.withColumn("differ", F.expr("if(side = 0, size(peel.found), 0)"))
    split = "transform(if(side = 0, cast(array() as array<int>), sequence(0, side - 1)), g -> named_struct('a', filter({a}, k -> pmod({k}, side) = g), 'b', filter({b}, k -> pmod({k}, side) = g)))"
    df = df.withColumn("coarse", F.expr(split.format(a=a, b=b, k="k")))
    fine = split.format(a="t.a", b="t.b", k="shiftright(k, 24)")
    df = df.withColumn("open", F.expr(f"flatten(transform(coarse, t -> {fine}))"))
    for salt, w in RETRIES:
        both = f"concat({placed('e.a', w, salt)}, {placed('e.b', w, salt, -1)})"
        df = df.withColumn("keyed", F.expr(f"transform(open, e -> {both})"))
        df = df.withColumn("minus", F.expr(f"transform(keyed, y -> {cells('y', w)})"))
        df = df.withColumn("peels", F.expr(f"transform(minus, d -> {peeled('d', w, salt)})"))
        df = df.withColumn("whole", F.expr(f"transform(peels, x -> {_empty('x')})"))
        df = df.withColumn("differ", F.expr("differ + aggregate(peels, 0, (n, x) -> n + if(" + _empty("x") + ", size(x.found), 0))"))
        df = df.withColumn("open", F.expr("transform(filter(arrays_zip(open, whole), e -> not e.whole), e -> e.open)"))
    rest = "aggregate(open, 0, (n, e) -> n + size(array_except(e.a, e.b)) + size(array_except(e.b, e.a)))"
    total = f"(size({a}) + size({b}))"
    return df.select(*have, F.expr(f"if({total} = 0, 1D, 1D - (differ + {rest}) / cast({total} as double))").alias(out))


def printed(sketch: str, keys: str) -> str:
    return f"concat(size({keys}), '/{3 * WIDTH}:', array_join(transform({sketch}, c -> concat_ws('.', cast(c.n as string), lower(hex(c.x)), lower(hex(c.h)))), ','))"


def _range_of(key: Column, splits: list[int]) -> Column:
    """How many sorted splits lie below key, by a search in two steps."""
    if not splits:
        return F.lit(0)
    step = max(1, math.isqrt(len(splits)))
    rows = [splits[i : i + step] for i in range(0, len(splits), step)]

    def numbers(x: list[int]) -> str:
        return f"cast(split('{','.join(map(str, x))}', ',') as array<bigint>)"

    top = F.size(F.filter(F.expr(numbers([r[-1] for r in rows])), lambda x: x < key))
    grid = F.expr(f"transform(split('{';'.join(','.join(map(str, r)) for r in rows)}', ';'), r -> cast(split(r, ',') as array<bigint>))")
    row = F.coalesce(F.try_element_at(grid, top + 1), F.expr("cast(array() as array<bigint>)"))
    return F.least(top * step, F.lit(len(splits))) + F.size(F.filter(row, lambda x: x < key))


def with_next(docs: DataFrame, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """doc_id, text and the ``next`` text in descending doc_id (after the last: the first), dealt by range."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    key, own = F.coalesce("doc_id", F.lit(-(2**63))), F.xxhash64("text")
    total = int(docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0)
    n = min(1 << 20, max(1, math.ceil(total / range_bytes)))
    at = [i / n for i in range(1, n)]
    found = sorted((docs.agg(F.percentile_approx(key, at, max(10_000, 10 * n))).first()[0] or []) if at else [])
    held = Counter(found)
    splits = sorted(held)
    # parts of a range of ids (splits[i - 1], splits[i]] in the order of documents: an id that fills several ranges is cut
    # by its texts' hashes and comes first, the others follow
    cut = [held[v] if held[v] > 1 else 0 for v in splits] + [0]
    before = [0, *accumulate(c + 1 for c in reversed(cut[1:]))][::-1]

    def numbers(x: list[int], kind: str = "bigint") -> Column:
        return F.expr(f"cast(split('{','.join(map(str, x))}', ',') as array<{kind}>)")

    base = F.col("base") + 1
    parts = F.element_at(numbers(cut), base)
    hot = (parts > 0) & (F.element_at(numbers([*splits, 0]), base) == F.col("key"))
    part = F.when(hot, F.least(F.floor((F.col("hash").cast("double") + 2.0**63) / 2.0**64 * parts), parts - 1)).otherwise(parts)
    ranged = docs.withColumn("key", key).withColumn("hash", own).withColumn("base", _range_of(F.col("key"), splits))
    ranged = ranged.withColumn("range", (F.element_at(numbers(before), base) + part).cast("int")).drop("base")
    heads = {r[0]: r[1] for r in ranged.groupBy("range").agg(F.min(F.struct(F.bitwise_not("key").alias("k"), F.col("hash").alias("h")))).collect()}
    order = sorted(heads)
    if not order:
        return ranged.select("range", "doc_id", "text", F.lit("").alias("next"), F.lit(False).alias("ghost"))
    ahead = {r: order[i - 1] for i, r in enumerate(order)}  # the first range's head follows the last row of all
    size = order[-1] + 1
    place = F.col("range") + 1
    first = [F.element_at(numbers([heads[i][j] if i in heads else 0 for i in range(size)]), place) for j in range(2)]
    goes = F.element_at(numbers([ahead.get(i, 0) for i in range(size)], "int"), place)
    stays = F.struct(F.col("range").alias("r"), F.lit(False).alias("ghost"))
    also = F.struct(goes.alias("r"), F.lit(True).alias("ghost"))
    places = F.when((first[0] == F.bitwise_not("key")) & (first[1] == F.col("hash")), F.array(stays, also)).otherwise(F.array(stays))
    dealt = ranged.withColumn("to", F.explode(places)).select(F.col("to.r").alias("range"), F.col("to.ghost").alias("ghost"), "key", "doc_id", "text")
    return dealt.repartition("range")


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next."""
    dealt = with_next(docs)
    if "next" in dealt.columns:  # an empty table
        return dealt.selectExpr("doc_id", "0L as n_chars", "'' as edited_sha256", "'' as fingerprint", "'' as edited_fingerprint", "0D as near_edited", "0D as near_next")
    own = dealt.withColumn("keys", F.expr(digests("text"))).withColumn("placed", F.expr(placed("keys", WIDTH, 1)))
    own = own.withColumn("sketch", F.expr(cells("placed", WIDTH))).drop("placed")
    follow = W.partitionBy("range").orderBy("ghost", F.desc("key"), F.xxhash64("text"), "text")
    rows = own
    for c in ("text", "keys", "sketch"):
        rows = rows.withColumn(f"next_{c}", F.lead(c).over(follow))
    half = "cast(length(text) div 2 as int)"
    rows = rows.where("not ghost").withColumn("edited", F.expr(f"concat(substring(text, 1, length(text) - {half}), substring(next_text, 1, {half}))"))
    rows = rows.select("doc_id", F.expr("cast(length(text) as long)").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"), "keys", "sketch", "next_keys", "next_sketch", F.expr(digests("edited")).alias("edited_keys"))
    rows = rows.withColumn("placed", F.expr(placed("edited_keys", WIDTH, 1))).withColumn("edited_sketch", F.expr(cells("placed", WIDTH))).drop("placed")
    rows = with_likeness(rows, "sketch", "keys", "edited_sketch", "edited_keys", "near_edited")
    rows = with_likeness(rows, "sketch", "keys", "next_sketch", "next_keys", "near_next")
    return rows.select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        F.expr(printed("sketch", "keys")).alias("fingerprint"),
        F.expr(printed("edited_sketch", "edited_keys")).alias("edited_fingerprint"),
        "near_edited",
        "near_next",
    )
