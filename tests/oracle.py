"""Runs a query in Spark and its SQL in DuckDB over one directory and compares the rows."""

import glob
import math
import os

import duckdb


def norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(round(v, 9) + 0.0)
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(map(norm, v)) + "]"
    if hasattr(v, "asDict"):
        return norm(list(v.asDict().values()))
    return repr(v)


def tables(directory):
    con = duckdb.connect()
    for f in glob.glob(f"{directory}/*.parquet"):
        con.execute(f"create view {os.path.basename(f)[:-8]} as from read_parquet('{f}{'/*' if os.path.isdir(f) else ''}')")
    return con


def compare(spark, con, directory, query, sql):
    df = query(spark, directory)
    cols = sorted(df.columns)
    got = sorted(tuple(norm(r[c]) for c in cols) for r in df.collect())
    cur = con.execute(sql)
    names = [x[0] for x in cur.description]
    assert sorted(names) == cols
    want = sorted(tuple(norm(r[names.index(c)]) for c in cols) for r in cur.fetchall())
    assert got == want, (sorted(set(got) - set(want))[:3], sorted(set(want) - set(got))[:3])
