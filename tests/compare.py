"""Run queries in Spark and their SQL in DuckDB and compare rows."""

from __future__ import annotations

import datetime as dt
import decimal
import glob
import math
import os

import duckdb


def plain(v):
    if v is None:
        return None
    if isinstance(v, float) and math.isnan(v):
        return None
    if hasattr(v, "item"):
        v = v.item()
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, bool):
        return v
    if isinstance(v, (int, float)):
        return round(float(v), 9) + 0.0
    if isinstance(v, dt.datetime):
        return v.replace(tzinfo=None)
    return v


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in data), key=lambda t: tuple((x is None, str(type(x)), str(x)) for x in t))


def connect(sf_dir: str):
    con = duckdb.connect()
    con.execute("set TimeZone='UTC'")
    for f in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return con


def compare(spark, con, sf_dir: str, query, sql: str) -> str | None:
    """None if both give the same rows, else what differs."""
    df = query(spark, sf_dir)
    a = rows(df.columns, df.collect())
    cur = con.execute(sql)
    cols = [c[0] for c in cur.description]
    b = rows(cols, cur.fetchall())
    if sorted(df.columns) != sorted(cols):
        return f"columns {sorted(df.columns)} and {sorted(cols)}"
    if len(a) != len(b):
        return f"{len(a)} and {len(b)} rows"
    bad = [(x, y) for x, y in zip(a, b) if x != y]
    return f"{len(bad)} of {len(a)} rows differ, {sorted(df.columns)}: {bad[:2]}" if bad else None
