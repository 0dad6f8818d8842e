"""Run Spark queries next to their DuckDB statements and compare the rows."""

from __future__ import annotations

import glob
import os
import re

import duckdb
from pyspark.sql import DataFrame


def duckdb_tables(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.splitext(os.path.basename(path))[0]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return con


def _ordered(columns: list[str], rows: list[tuple]) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(row[i] for i in order) for row in rows), key=repr)


def ordered(sql: str) -> bool:
    """Whether a statement says in which order its rows come."""
    return bool(re.search(r"ORDER BY [^()]*$", sql))


def differences(df: DataFrame, con: duckdb.DuckDBPyConnection, sql: str, in_order: bool = False) -> str | None:
    """None when names and rows agree, ``in_order`` or as multisets, else what
    differs."""
    mine = [tuple(row) for row in df.collect()]
    cursor = con.execute(sql)
    names = [item[0] for item in cursor.description]
    theirs = cursor.fetchall()
    if sorted(df.columns) != sorted(names):
        return f"columns {sorted(df.columns)} != {sorted(names)}"
    left, right = _ordered(df.columns, mine), _ordered(names, theirs)
    if left == right:
        where = [df.columns.index(name) for name in names]
        apart = next((n for n, (row, other) in enumerate(zip(mine, theirs, strict=True)) if tuple(row[i] for i in where) != other), None)
        return f"row {apart} is in another place" if in_order and apart is not None else None
    extra = [row for row in left if row not in right][:2]
    missing = [row for row in right if row not in left][:2]
    return f"{len(left)} rows against {len(right)}; only Spark: {extra}; only DuckDB: {missing}"
