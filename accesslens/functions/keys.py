"""Restricting a large table to a set of key values."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MAX_LISTED = 10_000


def key_values(df: DataFrame, column: str, max_listed: int = MAX_LISTED) -> list | DataFrame:
    """The distinct values of a column: a list while they are few, else a table."""
    distinct = df.select(column).where(F.col(column).isNotNull()).distinct()
    listed = [row[0] for row in distinct.limit(max_listed + 1).collect()]
    return listed if len(listed) <= max_listed else distinct


def restrict_to(df: DataFrame, column: str, values: DataFrame | list, max_listed: int = MAX_LISTED) -> DataFrame:
    """Rows of ``df`` whose ``column`` occurs in ``values``.

    A small value set (calendar dates, mostly) becomes a literal list, which
    prunes partitions while planning.  A larger one is joined and Spark picks
    the join from its statistics.
    """
    if not isinstance(values, list):
        values = key_values(values, column, max_listed)
    if isinstance(values, list):
        return df.where(F.col(column).isin(values))
    return df.join(values, column, "left_semi")
