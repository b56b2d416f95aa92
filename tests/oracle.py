"""Compares a query with its DuckDB form: rows sorted, columns by name, doubles to 6 significant places."""

import os

import duckdb
import pandas as pd

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(d):
    con = duckdb.connect()
    for t in TABLES:
        p = f"{d}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}{'/*.parquet' if os.path.isdir(p) else ''}')")
    return con


def norm(df):
    df = df[sorted(df.columns)]
    show = lambda x: "NULL" if x is None or (not isinstance(x, (list, tuple)) and not hasattr(x, "__len__") and pd.isna(x)) else f"{x:.6g}" if isinstance(x, float) and x != int(x) else str(int(x)) if isinstance(x, float) else str(x)[:10] if type(x).__name__ in ("Timestamp", "datetime", "date") else str([str(y) for y in x]) if hasattr(x, "__len__") and not isinstance(x, str) else str(x)
    return sorted(tuple(show(v) for v in r) for r in df.astype(object).itertuples(index=False))


def compare(spark, con, d, f, sql):
    got, want = f(spark, d).toPandas(), con.execute(sql).df()
    assert sorted(got.columns) == sorted(want.columns), (sorted(got.columns), sorted(want.columns))
    a, b = norm(got), norm(want)
    assert len(a) == len(b), (len(a), len(b), a[:3], b[:3])
    bad = [(x, y) for x, y in zip(a, b, strict=True) if x != y]
    assert not bad, (len(bad), bad[:3])
    return len(a)
