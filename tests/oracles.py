"""Comparing queries with their DuckDB SQL, as multisets of rows."""

import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
KINDS = {"int": "INTEGER", "bigint": "BIGINT", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}
SMALL = "/root/testdata/sf0.001"


def connection(sf_dir=SMALL):
    con = duckdb.connect()
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        if os.path.exists(path):
            con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{path}'")
    return con


def multiset(rows):
    clean = lambda x: x + 0.0 if isinstance(x, float) else x  # noqa: E731  no negative zero
    return sorted((tuple(map(clean, r)) for r in rows), key=lambda r: tuple((x is not None, repr(x)) for x in r))


def assert_same(df, sql, con):
    found = con.sql(sql)
    columns = sorted(df.columns)
    assert columns == sorted(found.columns)
    kinds = dict(zip(found.columns, map(str, found.dtypes)))
    assert {f.name: KINDS[f.dataType.simpleString()] for f in df.schema.fields} == kinds
    at = [found.columns.index(c) for c in columns]
    want = multiset(tuple(r[i] for i in at) for r in found.fetchall())
    assert multiset(tuple(r[c] for c in columns) for r in df.collect()) == want
    return len(want)
