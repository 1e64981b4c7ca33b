"""Likeness of decoded vectors: cosine, relative Frobenius distance, largest difference, equality.

Decoding of packed weights is outside this library; vectors come decoded.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / F.greatest(F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)), F.lit(1e-30))


def rel_frobenius(a: Column, b: Column) -> Column:
    """|a - b| / |b|; not symmetric."""
    gap = F.zip_with(a, b, lambda x, y: x.cast("double") - y.cast("double"))
    return F.sqrt(dot(gap, gap)) / F.greatest(F.sqrt(dot(b, b)), F.lit(1e-30))


def max_abs(a: Column, b: Column) -> Column:
    return F.array_max(F.zip_with(a, b, lambda x, y: F.abs(x.cast("double") - y.cast("double"))))


def same_values(a: Column, b: Column) -> Column:
    """Whether all values are equal, as numbers are: NaN equals nothing, -0 equals 0."""
    return (F.size(a) == F.size(b)) & F.forall(F.zip_with(a, b, lambda x, y: (x == y) & ~F.isnan(x) & ~F.isnan(y)), lambda same: F.coalesce(same, F.lit(False)))


def with_metrics(pairs: DataFrame, a: str, b: str) -> DataFrame:
    x, y = F.col(a), F.col(b)
    return pairs.withColumns({"cosine": cosine(x, y), "rel_f": rel_frobenius(x, y), "max_abs": max_abs(x, y), "bitwise": same_values(x, y)})


MOST_HEADS = 10_000


def against(rows: DataFrame, keys: list[str], vector: str, heads: DataFrame) -> DataFrame:
    """Each row against each head (family, head): keys, family, cosine, rel_f. Heads are vectors of a checked number
    (MOST_HEADS) that go to all tasks; a batch of rows is one matrix, and each norm is computed once."""
    got = heads.select("family", "head").limit(MOST_HEADS + 1).collect()
    if len(got) > MOST_HEADS:
        raise ValueError(f"more than {MOST_HEADS} heads")
    names = [r.family for r in got]
    table = np.array([r.head for r in got], float).reshape(len(got), -1)
    sizes = np.sqrt((table * table).sum(axis=1))
    kind = heads.schema["family"].dataType

    def run(batches):
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_type

        for batch in batches:
            if not batch.num_rows or not names:
                continue
            x = np.array(batch.column(vector).to_pylist(), float)
            own = np.sqrt((x * x).sum(axis=1))
            for name, head, size in zip(names, table, sizes):
                cos = (x @ head) / np.maximum(own * size, 1e-30)
                gap = np.sqrt(((x - head) ** 2).sum(axis=1)) / max(size, 1e-30)
                cols = [batch.column(k) for k in keys]
                yield pa.RecordBatch.from_arrays([*cols, pa.array([name] * len(x), to_arrow_type(kind)), pa.array(cos), pa.array(gap)], names=[*keys, "family", "cosine", "rel_f"])

    schema = rows.select(*keys).schema.add("family", kind).add("cosine", "double").add("rel_f", "double")
    return rows.select(*keys, vector).where(F.col(vector).isNotNull()).mapInArrow(run, schema)


def similarity(pairs: DataFrame, by: list[str]) -> DataFrame:
    """Rollup of with_metrics (or against): least cosine starts at 1 and the largest distances at 0."""
    more = [F.greatest(F.lit(0.0), F.max("max_abs")).alias("max_abs"), F.bool_and("bitwise").alias("bitwise")] if "bitwise" in pairs.columns else []
    return pairs.groupBy(*by).agg(
        F.count("*").alias("n"),
        F.avg("cosine").alias("cos_mean"),
        F.least(F.lit(1.0), F.min("cosine")).alias("cos_min"),
        F.avg("rel_f").alias("rel_f_mean"),
        F.greatest(F.lit(0.0), F.max("rel_f")).alias("rel_f_max"),
        *more,
    )


def decoder(dtype: str):
    """A UDF from raw little-endian bytes of F16, BF16, I16, I32 or F32 to doubles."""
    kinds = {"F16": "<f2", "I16": "<i2", "I32": "<i4", "F32": "<f4"}

    @F.pandas_udf("array<double>")
    def decode(raw: pd.Series) -> pd.Series:
        def one(x):
            if x is None:
                return None
            if dtype == "BF16":
                return (np.frombuffer(x, "<u2").astype("<u4") << 16).view("<f4").astype(float)
            return np.frombuffer(x, kinds[dtype]).astype(float)

        return raw.map(one)

    return decode


def decoded(tensors: DataFrame, read) -> DataFrame:
    """name, values of tensors (name, dtype, path, start, stop) of the decodable types, read and decoded. read(requests):
    see sources.read_spans."""
    got = read(tensors.select("path", "start", "stop").distinct()).select("path", "start", "stop", "content")
    rows = tensors.join(got, ["path", "start", "stop"])
    values = F.lit(None).cast("array<double>")
    for dtype in ("F16", "BF16", "I16", "I32", "F32"):
        values = F.when(F.col("dtype") == dtype, decoder(dtype)(F.when(F.col("dtype") == dtype, F.col("content")))).otherwise(values)
    return rows.select("name", values.alias("values"))
