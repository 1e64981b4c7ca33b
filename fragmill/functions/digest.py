"""Digests of whole files, spans and ordered concatenations; canonical JSON."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

BLOCK = 16 << 20


def canonical_json(value) -> bytes:
    """Sorted keys, no white space, ASCII only: the bytes that are signed."""
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=True).encode()


@F.pandas_udf(StringType())
def canonical(texts: pd.Series) -> pd.Series:
    """Canonical form of JSON texts; NULL for what isn't JSON."""

    def one(x):
        try:
            return canonical_json(json.loads(x)).decode()
        except (TypeError, ValueError, RecursionError):
            return None

    return texts.map(one)


def file_digest(content: Column) -> Column:
    return F.sha2(content, 256)


def span_digest(content: Column, lo: Column, hi: Column) -> Column:
    return F.sha2(F.substring(content, (lo + 1).cast("int"), (hi - lo).cast("int")), 256)


def git_blob(content: Column) -> Column:
    """sha1 of "blob <length>\\0" and the content."""
    head = F.concat(F.encode(F.concat(F.lit("blob "), F.octet_length(content).cast("string")), "UTF-8"), F.unhex(F.lit("00")))
    return F.sha1(F.concat(head, content))


def source_fingerprint(**fields: str) -> str:
    return hashlib.sha256(canonical_json(fields)).hexdigest()[:16]


def group_digest(df: DataFrame, by: list[str], order: str, content: str) -> DataFrame:
    """Digest of each group's contents joined in order. A group is hashed by one task, piece after piece from
    rows sorted in the shuffle, and holds one piece in memory at a time."""
    keys = df.select(*by).schema

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        key = state = None
        done: list[tuple] = []
        for batch in batches:
            cols = [batch.column(c).to_pylist() for c in by]
            for *k, x in zip(*cols, batch.column(content)):
                if k != key:
                    if state is not None:
                        done.append((*key, state.hexdigest()))
                    key, state = k, hashlib.sha256()
                if x.is_valid:
                    state.update(x.as_buffer())
        if state is not None:
            done.append((*key, state.hexdigest()))
        if done:
            yield pa.RecordBatch.from_pylist([dict(zip([*by, "digest"], r)) for r in done])

    schema = keys.add("digest", "string")
    rows = df.select(*by, order, F.col(content).cast("binary").alias(content))
    return rows.repartition(*by).sortWithinPartitions(*by, order).mapInArrow(run, schema)


def source_fingerprint_column(**fields: Column) -> Column:
    """source_fingerprint over columns of printable ASCII without quotes or backslashes."""
    parts = [F.concat(F.lit(f'"{k}":"'), F.coalesce(v, F.lit("")), F.lit('"')) for k, v in sorted(fields.items())]
    return F.substring(F.sha2(F.concat(F.lit("{"), F.concat_ws(",", *parts), F.lit("}")), 256), 1, 16)


def spans_of_file(content: Column, spans: Column) -> Column:
    """Digests of a file and of its spans (array of struct lo, hi) in one expression over one scan."""
    return F.struct(F.sha2(content, 256).alias("sha256"), F.transform(spans, lambda s: F.sha2(F.substring(content, (s.lo + 1).cast("int"), (s.hi - s.lo).cast("int")), 256)).alias("spans"))


def stream_digest(read, blocks: int = BLOCK) -> str:
    """Digest of a file object read in blocks."""
    h = hashlib.sha256()
    while data := read(blocks):
        h.update(data)
    return h.hexdigest()
