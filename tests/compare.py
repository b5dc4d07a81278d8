"""Runs one registered query in Spark and its SQL text in DuckDB and compares all values."""

from __future__ import annotations

import datetime
import decimal
import math
from collections import Counter

import duckdb

from isoreach.fixtures import TABLES


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    return con


def plain(value):
    if isinstance(value, decimal.Decimal):
        return float(value)
    if isinstance(value, float):
        if math.isnan(value):
            return "NaN"
        return value + 0.0
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None)
    return value


def spark_rows(df):
    columns = sorted(df.columns)
    return columns, [tuple(plain(r[c]) for c in columns) for r in df.collect()]


def duck_rows(con, sql):
    cursor = con.execute(sql)
    names = [d[0] for d in cursor.description]
    order = sorted(range(len(names)), key=lambda i: names[i])
    rows = [tuple(plain(r[i]) for i in order) for r in cursor.fetchall()]
    return sorted(names), rows


def difference(df, con, sql) -> str | None:
    """None when equal; otherwise what differs. Values are compared exactly, with their types."""
    s_cols, s_rows = spark_rows(df)
    d_cols, d_rows = duck_rows(con, sql)
    if s_cols != d_cols:
        return f"columns {s_cols} != {d_cols}"
    if len(s_rows) != len(d_rows):
        return f"rows {len(s_rows)} != {len(d_rows)}"
    typed = lambda rows: Counter(tuple((type(v).__name__, v) for v in r) for r in rows)
    s, d = typed(s_rows), typed(d_rows)
    if s != d:
        only_s, only_d = list((s - d).keys())[:2], list((d - s).keys())[:2]
        return f"{sum((s - d).values())} rows differ; columns {s_cols}\n  spark {only_s}\n  duck  {only_d}"
    return None
