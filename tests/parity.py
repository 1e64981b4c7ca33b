"""Runs a query on Spark and its SQL on DuckDB and compares rows regardless of order."""

from __future__ import annotations

import glob
import math
import os

import duckdb


def duck(sf: str):
    con = duckdb.connect()
    for path in glob.glob(f"{sf}/*.parquet"):
        name = os.path.basename(path).removesuffix(".parquet")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return con


def norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(round(v, 9) + 0.0)
    return str(v)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(columns), sorted([norm(r[i]) for i in order] for r in rows)


def compare(spark, sf, f, sql):
    df = f(spark, sf)
    got = rows_of(df.columns, df.collect())
    cur = duck(sf).execute(sql)
    want = rows_of([d[0] for d in cur.description], cur.fetchall())
    return got, want
