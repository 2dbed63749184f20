"""Row-by-row comparison of a Spark result with DuckDB's answer to a query's SQL."""

import glob
import math
import os
from collections import Counter

import duckdb


def connect(sf_dir):
    con = duckdb.connect()
    for f in glob.glob(f"{sf_dir}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


def plain(v):
    if v is None:
        return "null"
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v + 0.0:.6g}"
    if isinstance(v, int) and not isinstance(v, bool):
        return f"{v:.6g}" if abs(v) < 1e6 else str(v)
    if isinstance(v, list | tuple):
        return "[" + ",".join(map(plain, v)) + "]"
    return str(v)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], Counter(tuple(plain(r[i]) for i in order) for r in rows)


def same(df, con, sql):
    a = rows_of(df.columns, [tuple(r) for r in df.collect()])
    rel = con.sql(sql)
    b = rows_of(rel.columns, rel.fetchall())
    assert a[0] == b[0]
    assert not (a[1] - b[1]) and not (b[1] - a[1]), (list((a[1] - b[1]).items())[:3], list((b[1] - a[1]).items())[:3])
