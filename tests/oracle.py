"""Rows of a Spark query against rows of its SQL in DuckDB."""

import os

import duckdb

DATA = os.environ.get("TESSERA_TESTDATA", "/root/testdata")


def normal(value):
    if isinstance(value, float):
        return None if value != value else format(value, ".6g")
    return None if value is None else str(value)


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(str(tuple(normal(r[i]) for i in order)) for r in data)


def duck(sql, sf):
    c = duckdb.connect()
    for name in os.listdir(f"{DATA}/{sf}"):
        c.execute(f"create view {name[:-8]} as select * from '{DATA}/{sf}/{name}'")
    found = c.execute(sql)
    return [d[0] for d in found.description], found.fetchall()


def assert_same(spark, query, sql, sf="sf0.001"):
    frame = query(spark, f"{DATA}/{sf}")
    columns, expected = duck(sql, sf)
    assert sorted(frame.columns) == sorted(columns)
    got = rows(frame.columns, frame.collect())
    assert got == rows(columns, expected)
    return len(got)
