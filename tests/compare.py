"""Compare a Spark result with DuckDB's on the same tables."""

from __future__ import annotations

import glob
import os

import duckdb
import pandas as pd


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in glob.glob(f"{folder}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM read_parquet('{path}')")
    return con


def _plain(value):
    if value is None or value is pd.NaT or (isinstance(value, float) and value != value):
        return None
    if isinstance(value, pd.Timestamp):
        return value.to_pydatetime().replace(tzinfo=None)
    if hasattr(value, "tzinfo") and value.tzinfo is not None:
        return value.replace(tzinfo=None)
    if isinstance(value, float):
        return 0.0 if value == 0 else value
    return value


def differences(spark_rows, spark_columns, con, sql: str) -> list[str]:
    """What differs in columns, kinds of values, row count or rows; an empty list means equal."""
    cursor = con.execute(sql)
    names = [d[0] for d in cursor.description]
    theirs = cursor.fetchall()
    if sorted(names) != sorted(spark_columns):
        return [f"columns {sorted(spark_columns)} against {sorted(names)}"]
    order = sorted(names)
    mine = sorted([tuple(_plain(r[c]) for c in order) for r in spark_rows], key=repr)
    other = sorted([tuple(_plain(r[names.index(c)]) for c in order) for r in theirs], key=repr)
    found = []
    if len(mine) != len(other):
        found.append(f"{len(mine)} rows against {len(other)}")
    for a, b in zip(mine, other):
        if a != b:
            found.append(f"{a} against {b}")
        kinds = [(c, type(x), type(y)) for c, x, y in zip(order, a, b) if x is not None and y is not None and type(x) is not type(y)]
        if kinds:
            found.append(f"kinds {kinds}")
        if len(found) > 3:
            break
    return found
