"""Rows of a DataFrame against rows of an SQL engine over the same tables."""

import math

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if isinstance(v, float):
        return round(v, 6) + 0.0 if math.isfinite(v) else str(v)
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    return v


def views(sf_dir):
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return c


def same(df, connection, sql):
    cols = sorted(df.columns)
    got = sorted((tuple(plain(r[k]) for k in cols) for r in df.collect()), key=str)
    rel = connection.sql(sql.strip())
    assert sorted(rel.columns) == cols
    at = [rel.columns.index(k) for k in cols]
    assert got == sorted((tuple(plain(r[i]) for i in at) for r in rel.fetchall()), key=str)
