"""Compare a query with its SQL in DuckDB, rows as multisets."""

from __future__ import annotations

import datetime
import decimal
import os

import duckdb

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def _plain(v):
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, float) and v == int(v):
        v = int(v)
    return v.replace(tzinfo=None).isoformat() if isinstance(v, datetime.datetime) else v


def compare(spark, query, sql, sf=SF):
    df = query(spark, sf)
    columns = sorted(df.columns)
    mine = sorted(repr([_plain(r[c]) for c in columns]) for r in df.collect())
    con = duckdb.connect()
    for f in os.listdir(sf):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{sf}/{f}'")
    res = con.execute(sql)
    names = [d[0] for d in res.description]
    assert sorted(names) == columns
    theirs = sorted(repr([_plain(r[names.index(c)]) for c in columns]) for r in res.fetchall())
    assert mine == theirs
