"""Order-insensitive comparison of a Spark result with a DuckDB result on the same tables."""

from __future__ import annotations

import glob
import math
import os
from collections import Counter

import duckdb
import pandas as pd


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in glob.glob(f"{folder}/*.parquet"):
        name = os.path.basename(path)[: -len(".parquet")]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return con


def cell(value):
    if value is None or value is pd.NaT or (isinstance(value, float) and math.isnan(value)):
        return None
    if isinstance(value, float):
        return float(f"{value:.10g}")
    return value


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(cell(r[i]) for i in order) for r in rows)


def differences(df, con, sql: str) -> list[str]:
    """Nothing if both give the same columns, types of values and rows."""
    found = [tuple(r) for r in df.collect()]
    result = con.execute(sql)
    names = [d[0] for d in result.description]
    expected = result.fetchall()
    problems = []
    if sorted(df.columns) != sorted(names):
        return [f"columns: {sorted(df.columns)} != {sorted(names)}"]
    ours, theirs = rows_of(df.columns, found), rows_of(names, expected)
    if len(found) != len(expected):
        problems.append(f"rows: {len(found)} != {len(expected)}")
    if ours != theirs:
        problems.append(f"only in Spark: {list((ours - theirs).items())[:3]}")
        problems.append(f"only in oracle: {list((theirs - ours).items())[:3]}")
    for row in ours:
        match = next(iter(theirs), None)
        if match and any(
            a is not None and b is not None and type(a) is not type(b) for a, b in zip(row, match)
        ):
            problems.append(f"types: {row} / {match}")
        break
    return problems
