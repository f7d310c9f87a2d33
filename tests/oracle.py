"""Compares a query's rows with those of its SQL in DuckDB."""

from __future__ import annotations

import glob
import math
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        path = f"{sf_dir}/{name}.parquet"
        if os.path.exists(path):
            con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path + '/*.parquet' if os.path.isdir(path) else path}')")
    return con


def _plain(x):
    if isinstance(x, float):
        return None if math.isnan(x) else round(x, 5) + 0.0
    if isinstance(x, (list, tuple)):
        return tuple(_plain(y) for y in x)
    return x


def rows_of(columns: list[str], rows) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return sorted((tuple(_plain(r[k]) for k in order) for r in rows), key=repr)


def differences(df, sql: str, con) -> str:
    """Empty if both give the same columns and rows."""
    found = con.execute(sql)
    names = [d[0] for d in found.description]
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} and {sorted(names)}"
    ours, theirs = rows_of(df.columns, [tuple(r) for r in df.collect()]), rows_of(names, found.fetchall())
    if ours == theirs:
        return ""
    ours_only, theirs_only = set(map(repr, ours)) - set(map(repr, theirs)), set(map(repr, theirs)) - set(map(repr, ours))
    return f"{len(ours)} and {len(theirs)} rows; only ours {sorted(ours_only)[:3]}, only theirs {sorted(theirs_only)[:3]}"
