"""Comparison of a Spark query with its SQL on DuckDB."""

import glob
import math
import os
from collections import Counter

import duckdb


def connect(folder):
    db = duckdb.connect()
    db.execute("set timezone = 'UTC'")
    for path in glob.glob(f"{folder}/*.parquet"):
        db.execute(f"create view {os.path.basename(path)[:-8]} as select * from '{path}'")
    return db


def plain(value):
    if value is None or isinstance(value, float) and math.isnan(value) or str(value) in ("NaT", "<NA>"):
        return None
    if isinstance(value, bool) or type(value).__name__ in ("bool", "bool_"):
        return str(bool(value))
    if isinstance(value, (int, float)) or getattr(getattr(value, "dtype", None), "kind", "") in ("i", "u", "f"):
        return f"{float(value):.6g}"
    return str(value)


def rows(frame):
    columns = sorted(frame.columns)
    return columns, Counter(tuple(map(plain, x)) for x in frame[columns].itertuples(index=False))
