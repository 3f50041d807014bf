"""Compares a query with its SQL, as the driver does: row count, columns and an order-insensitive comparison of values."""

from __future__ import annotations

import datetime
import decimal
import math

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(x):
    if isinstance(x, decimal.Decimal):
        return plain(float(x)) if x % 1 else int(x)
    if isinstance(x, float):
        return "nan" if math.isnan(x) else float(f"{x:.9g}")
    if isinstance(x, (list, tuple)):
        return tuple(plain(y) for y in x)
    if isinstance(x, dict):
        return tuple(plain(y) for y in x.values())
    if isinstance(x, (bytes, bytearray)):
        return bytes(x)
    if isinstance(x, datetime.datetime):
        return x.isoformat()
    return x


def compare(spark, query, sql: str, sf_dir: str) -> None:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    want = con.execute(sql)
    names = [d[0] for d in want.description]
    rows = want.fetchall()
    df = query(spark, sf_dir)
    assert sorted(names) == sorted(df.columns), (names, df.columns)
    got = df.select(*names).collect()
    key = lambda r: repr(r)
    a, b = sorted((plain(tuple(r)) for r in got), key=key), sorted((plain(tuple(r)) for r in rows), key=key)
    assert len(a) == len(b), (len(a), len(b), a[:3], b[:3])
    for x, y in zip(a, b):
        assert x == y, (x, y)
    assert a or not b
