"""Rows of a query against rows of its SQL in DuckDB."""

from __future__ import annotations

import math
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connection(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{path}{'/*.parquet' if os.path.isdir(path) else ''}'")
    return con


def plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return None
    return v.item() if hasattr(v, "item") else v


def order(row):
    return tuple((v is None, isinstance(v, str), str(v) if isinstance(v, str) else 0, 0 if v is None or isinstance(v, str) else float(v)) for v in row)


def assert_same(df, sql: str, con) -> int:
    names = sorted(df.columns)
    mine = sorted(([plain(r[c]) for c in names] for r in df.collect()), key=order)
    found = con.sql(sql)
    assert sorted(found.columns) == names
    at = [found.columns.index(c) for c in names]
    theirs = sorted(([plain(r[i]) for i in at] for r in found.fetchall()), key=order)
    assert len(mine) == len(theirs)
    assert mine == theirs
    return len(mine)
