"""Compares a registered query with its SQL in DuckDB."""

import math

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(_plain(r[i]) for i in order) for r in data), key=repr)


def _plain(x):
    if isinstance(x, float):
        return None if math.isnan(x) else round(x, 9)
    if isinstance(x, (bytes, bytearray)):
        return bytes(x).hex()
    if isinstance(x, (list, tuple)):
        return tuple(map(_plain, x))
    return x


def assert_same(spark, query, sql, folder):
    con = duckdb.connect()
    con.sql("SET TimeZone='UTC'")
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    want = con.sql(sql)
    names = list(want.columns)
    df = query(spark, folder)
    assert sorted(df.columns) == sorted(names)
    got, expected = rows(df.columns, df.collect()), rows(names, want.fetchall())
    assert len(got) == len(expected)
    for g, w in zip(got, expected, strict=True):
        assert g == w
