"""Runs a query and its SQL on the same tables and compares their rows."""

from __future__ import annotations

import glob
import os

import duckdb


def connect(sf_dir: str):
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path).removesuffix(".parquet")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return con


def same(x):
    if isinstance(x, float):
        return round(x, 5) + 0.0
    return str(x)[:10] if hasattr(x, "year") else x


def compare(df, con, sql: str) -> str:
    """What differs, or an empty text."""
    result = con.execute(sql)
    names = [c[0] for c in result.description]
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} and {sorted(names)}"
    order = sorted(names)
    want = sorted((tuple(same(r[names.index(c)]) for c in order) for r in result.fetchall()), key=str)
    got = sorted((tuple(same(r[c]) for c in order) for r in df.collect()), key=str)
    if got == want:
        return ""
    a, b = sorted(set(got) - set(want), key=str), sorted(set(want) - set(got), key=str)
    return f"{len(got)} and {len(want)} rows; only here: {a[:3]}; only there: {b[:3]}"
