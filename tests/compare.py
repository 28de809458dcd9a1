"""Runs a query and its SQL on the same tables and compares the rows, whatever their order."""

from __future__ import annotations

import math

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def tables(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 6)
    return value


def same_rows(df, con, sql: str) -> None:
    cols = sorted(df.columns)
    ours = sorted((tuple(repr(plain(v)) for v in row) for row in df.select(*cols).collect()))
    result = con.execute(sql)
    names = [d[0] for d in result.description]
    assert sorted(names) == cols
    at = [names.index(c) for c in cols]
    theirs = sorted(tuple(repr(plain(row[i])) for i in at) for row in result.fetchall())
    assert ours == theirs
