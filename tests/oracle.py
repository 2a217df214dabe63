"""Compares a Spark result with SQL that DuckDB runs on the same tables."""

import math

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(folder):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{folder}/{t}.parquet'")
    return c


def plain(x):
    if x is None or (isinstance(x, float) and math.isnan(x)):
        return "null"
    if isinstance(x, (list, tuple)):
        return "[" + ",".join(plain(v) for v in x) + "]"
    if isinstance(x, (int, float)) and not isinstance(x, bool):
        return f"{float(x):.6g}" if abs(x) < 1e15 and x != int(x) else str(int(x)) if not math.isinf(x) else str(x)
    return str(x)


def same(df, sql, folder):
    names = sorted(df.columns)
    got = sorted(tuple(plain(r[n]) for n in names) for r in df.collect())
    rel = connect(folder).sql(sql)
    assert sorted(rel.columns) == names
    order = [rel.columns.index(n) for n in names]
    want = sorted(tuple(plain(r[i]) for i in order) for r in rel.fetchall())
    assert got == want
