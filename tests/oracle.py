"""Comparison of a query with its SQL in DuckDB on the smallest tables."""

from __future__ import annotations

import os

import duckdb

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connection():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def shown(v):
    if isinstance(v, float):
        return None if v != v else repr(v)
    if isinstance(v, int) and not isinstance(v, bool):
        return repr(float(v)) if abs(v) < 2**53 else str(v)
    return str(v) if v is not None else None


def same(spark, con, run, sql) -> None:
    got = run(spark, SF)
    names = sorted(got.columns)
    ours = sorted(tuple(str(shown(r[c])) for c in names) for r in got.collect())
    found = con.execute(sql)
    order = [d[0] for d in found.description]
    assert sorted(order) == names
    theirs = sorted(tuple(str(shown(r[order.index(c)])) for c in names) for r in found.fetchall())
    assert len(ours) == len(theirs)
    wrong = [(a, b) for a, b in zip(ours, theirs) if a != b]
    assert not wrong, wrong[:3]


def available() -> bool:
    return os.path.isdir(SF)
