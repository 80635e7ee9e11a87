"""Comparing rows of Spark and DuckDB."""

from collections import Counter
from decimal import Decimal

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def _cell(v):
    if isinstance(v, (float, Decimal)):
        return f"{float(v):.9g}" if v == v else "NULL"
    return "NULL" if v is None else str(v)


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(_cell(r[i]) for i in order) for r in data)


def same(df, con, sql):
    found = con.execute(sql)
    names = [c[0] for c in found.description]
    expected = found.fetchall()
    assert sorted(df.columns) == sorted(names)
    got = rows(df.columns, [tuple(r) for r in df.collect()])
    want = rows(names, expected)
    assert got == want, (list((got - want).items())[:3], list((want - got).items())[:3])
