"""Compares a query with its DuckDB SQL as sets of rows."""

from __future__ import annotations

import math
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
DATA = os.environ.get("TEST_DATA", "/root/testdata")


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{folder}/{t}.parquet')")
    return c


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    return v


def rows(columns: list[str], data) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in data), key=repr)


def differences(df, sql: str, folder: str) -> str:
    """Empty if the DataFrame and the SQL give the same columns and rows."""
    found = connect(folder).execute(sql)
    names = [x[0] for x in found.description]
    if sorted(df.columns) != sorted(names):
        return f"columns {sorted(df.columns)} and {sorted(names)}"
    want, got = rows(names, found.fetchall()), rows(df.columns, df.collect())
    if want == got:
        return ""
    missing, extra = [x for x in want if x not in set(got)][:3], [x for x in got if x not in set(want)][:3]
    return f"{len(got)} rows, {len(want)} wanted; missing {missing}; extra {extra}"
