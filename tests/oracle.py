"""Side-by-side comparison of a registered query and its SQL."""

from __future__ import annotations

import glob
import os
from collections import Counter

import duckdb


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in sorted(glob.glob(f"{sf_dir}/*.parquet")):
        name = os.path.basename(path).removesuffix(".parquet")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return con


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(str(row[i]) for i in order) for row in rows)


def difference(spark, query, sql: str, sf_dir: str, con=None) -> str | None:
    """None if both give the same columns and rows, else what differs."""
    con = con or connect(sf_dir)
    df = query(spark, sf_dir)
    actual = _rows(df.columns, df.collect())
    result = con.execute(sql)
    columns = [column[0] for column in result.description]
    expected = _rows(columns, result.fetchall())
    if sorted(df.columns) != sorted(columns):
        return f"columns {sorted(df.columns)} != {sorted(columns)}"
    if actual != expected:
        missing, extra = expected - actual, actual - expected
        return (
            f"{actual.total()} rows against {expected.total()}; missing e.g. "
            f"{list(missing)[:2]}; extra e.g. {list(extra)[:2]}"
        )
    if not expected:
        return "both empty"
    return None
