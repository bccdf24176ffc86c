"""Run a query and its SQL on the same tables and compare whole results."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for f in Path(sf_dir).glob("*.parquet"):
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM read_parquet('{f}')")
    return con


def cell(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(value)
    return "∅" if value is None else f"{type(value).__name__[0]}:{value}"


def rows(columns: list[str], data) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(cell(r[i]) for i in order) for r in data)


def differences(df, con, sql: str) -> str | None:
    """None when equal, else a short account of the difference."""
    cursor = con.execute(sql)
    theirs_columns = [d[0] for d in cursor.description]
    theirs = rows(theirs_columns, cursor.fetchall())
    mine = rows(df.columns, [tuple(r) for r in df.collect()])
    if sorted(df.columns) != sorted(theirs_columns):
        return f"columns {sorted(df.columns)} != {sorted(theirs_columns)}"
    if mine == theirs:
        return None
    left, right = set(mine) - set(theirs), set(theirs) - set(mine)
    return (
        f"{len(mine)} rows vs {len(theirs)}; columns {sorted(df.columns)}\n"
        f"only mine ({len(left)}): {sorted(left)[:3]}\nonly theirs ({len(right)}): {sorted(right)[:3]}"
    )
