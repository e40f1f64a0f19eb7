"""Runs queries and their SQL side by side and compares schema and values."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()

SPARK_TYPES = {
    "bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN",
    "timestamp": "TIMESTAMP",
}


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for table in TABLES:
        if Path(f"{sf_dir}/{table}.parquet").exists():
            con.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{sf_dir}/{table}.parquet')")
    return con


def _normal(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else value
    return value


def _rows(rows, order):
    return sorted(([_normal(r[i]) for i in order] for r in rows), key=lambda r: [(v is None, str(v)) for v in r])


def differences(df, con: duckdb.DuckDBPyConnection, sql: str) -> str | None:
    """None when the DataFrame equals the SQL result, a short text otherwise."""
    result = con.execute(sql)
    names = [c[0] for c in result.description]
    types = {c[0]: str(c[1]) for c in result.description}
    expected = result.fetchall()
    if sorted(df.columns) != sorted(names):
        return f"columns {sorted(df.columns)} != {sorted(names)}"
    for name, dtype in df.dtypes:
        if SPARK_TYPES.get(dtype) != types[name]:
            return f"type of {name}: {dtype} != {types[name]}"
    actual = df.collect()
    columns = sorted(names)
    left = _rows(actual, [df.columns.index(c) for c in columns])
    right = _rows(expected, [names.index(c) for c in columns])
    if len(left) != len(right):
        return f"{len(left)} rows != {len(right)} rows"
    for mine, theirs in zip(left, right):
        if mine != theirs:
            return f"{dict(zip(columns, mine))} != {dict(zip(columns, theirs))}"
    return None
