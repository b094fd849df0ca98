"""Runs a query on Spark and its oracle on DuckDB and compares the results."""

from __future__ import annotations

import datetime
import math

import duckdb

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem")


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    return con


def _cell(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else float(f"{value:.10g}")
    if isinstance(value, datetime.datetime):
        return value.isoformat()
    return value


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(_cell(r[i]) for i in order) for r in rows), key=repr)


def differences(df, con, sql) -> list[str]:
    """Human-readable differences, empty when the results agree."""
    result = con.execute(sql)
    names = [d[0] for d in result.description]
    expected = _rows(names, result.fetchall())
    actual = _rows(df.columns, [tuple(r) for r in df.collect()])
    found = []
    if sorted(names) != sorted(df.columns):
        found.append(f"columns {sorted(df.columns)} != {sorted(names)}")
    if len(expected) != len(actual):
        found.append(f"rows {len(actual)} != {len(expected)}")
    for a, e in zip(actual, expected):
        if a != e:
            found.append(f"spark {a}\noracle {e}")
            break
    kinds_a = [type(v).__name__ for v in (actual[0] if actual else ())]
    kinds_e = [type(v).__name__ for v in (expected[0] if expected else ())]
    if kinds_a != kinds_e:
        found.append(f"types {kinds_a} != {kinds_e}")
    if not expected:
        found.append("empty result")
    return found
