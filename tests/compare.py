"""Compares a DataFrame with the rows of a SQL query."""

from __future__ import annotations

import duckdb
from pyspark.sql import DataFrame


def cell(v: object) -> object:
    if isinstance(v, float):
        return float(f"{v:.9g}")
    return v.isoformat()[:10] if hasattr(v, "isoformat") and getattr(v, "hour", 0) == getattr(v, "minute", 0) == getattr(v, "second", 0) == getattr(v, "microsecond", 0) == 0 else v


def same(df: DataFrame, con: duckdb.DuckDBPyConnection, sql: str) -> int:
    """Compares rows without order; the number of rows."""
    found = con.execute(sql)
    names = [c[0] for c in found.description]
    assert sorted(names) == sorted(df.columns)
    order = sorted(names)
    theirs = sorted((repr(tuple(cell(r[names.index(c)]) for c in order)) for r in found.fetchall()))
    ours = sorted(repr(tuple(cell(r[c]) for c in order)) for r in df.collect())
    assert ours == theirs
    return len(ours)
