"""Rows of a query and of its SQL on the same files, in comparable form."""

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SF = "/root/testdata/sf0.001"


def plain(v):
    return repr(v) if isinstance(v, float) else str([plain(x) for x in v]) if isinstance(v, (list, tuple)) else str(v)


def both(spark, query, sql, sf=SF):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{sf}/{t}.parquet')")
    df = query(spark, sf)
    cols = sorted(df.columns)
    got = sorted(tuple(plain(r[c]) for c in cols) for r in df.collect())
    found = con.execute(sql)
    names = [d[0] for d in found.description]
    assert sorted(names) == cols
    at = [names.index(c) for c in cols]
    return got, sorted(tuple(plain(r[i]) for i in at) for r in found.fetchall())
