"""Runs a query's SQL in DuckDB and compares rows."""

import math

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir):
    import duckdb

    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return con


def _plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else str(round(v, 6) + 0.0)
    return str(v)


def same(df, con, sql):
    """Asserts equal columns and, in any order, equal rows."""
    result = con.execute(sql)
    names = [d[0] for d in result.description]
    assert sorted(names) == sorted(df.columns)
    cols = sorted(names)
    want = sorted(tuple(_plain(dict(zip(names, r))[c]) for c in cols) for r in result.fetchall())
    got = sorted(tuple(_plain(r[c]) for c in cols) for r in df.collect())
    assert got == want
