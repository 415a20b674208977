"""Rows of a Spark query against rows of SQL in DuckDB."""

from __future__ import annotations

import datetime
import glob
import os

import duckdb

DATA = os.environ.get("TIDEMILL_DATA", "/root/testdata/sf0.001")


def plain(value):
    if value is None or value != value:
        return None
    if isinstance(value, bool):
        return value
    if isinstance(value, float):
        return round(value, 5) + 0.0
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None)
    return value


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted([tuple(plain(r[i]) for i in order) for r in rows], key=repr)


def oracle(sql: str, data: str = DATA):
    con = duckdb.connect()
    for path in glob.glob(f"{data}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    con.execute(sql)
    return [d[0] for d in con.description], con.fetchall()


def assert_same(spark, query, sql: str, data: str = DATA) -> None:
    got = query(spark, data)
    columns, want = oracle(sql, data)
    assert sorted(got.columns) == sorted(columns)
    left, right = rows_of(got.columns, [tuple(r) for r in got.collect()]), rows_of(columns, want)
    assert len(left) == len(right)
    assert left == right
