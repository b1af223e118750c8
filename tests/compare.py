"""Run a registered query and its DuckDB twin on the same tables and compare."""

import math

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return None
    if isinstance(v, float):
        return round(v, 6)
    if hasattr(v, "asDict"):
        v = list(v.asDict().values())
    if isinstance(v, dict):
        v = list(v.values())
    return tuple(plain(x) for x in v) if isinstance(v, list | tuple) else v


def connect(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def assert_same(df, con, sql):
    names = sorted(df.columns)
    got = sorted((tuple(plain(r[n]) for n in names) for r in df.collect()), key=repr)
    cursor = con.execute(sql)
    found = [d[0] for d in cursor.description]
    assert sorted(found) == names
    want = sorted((tuple(plain(r[found.index(n)]) for n in names) for r in cursor.fetchall()), key=repr)
    assert got == want
