"""Comparison of a query with DuckDB on the same tables."""

import glob
import math
import os

import duckdb


def connect(root):
    c = duckdb.connect()
    c.execute("set timezone = 'UTC'")
    for f in glob.glob(f"{root}/*.parquet"):
        source = f"{f}/*.parquet" if os.path.isdir(f) else f
        c.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{source}'")
    return c


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(round(v, 6) + 0.0)
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    if hasattr(v, "asDict"):
        v = v.asDict()
    if isinstance(v, dict):
        return tuple((k, plain(x)) for k, x in v.items())
    return v


def same(df, connection, sql):
    cursor = connection.execute(sql)
    names = [d[0] for d in cursor.description]
    assert sorted(df.columns) == sorted(names)
    columns = sorted(names)
    want = sorted(repr(tuple(plain(r[names.index(c)]) for c in columns)) for r in cursor.fetchall())
    got = sorted(repr(tuple(plain(r[c]) for c in columns)) for r in df.collect())
    assert got == want
