"""Counting several distinct things per group without multiplying raw rows.

Two exact distinct counts in one aggregation would expand every event into
three rows.  Counting per (group, user, action, day) first shrinks the events
map-side, spreads a busy group over many reducers, and leaves only the small
roll-up to expand.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from accesslens.functions.events import failed
from accesslens.functions.time import from_iso


def rollup(df: DataFrame, *keys: Column | str) -> DataFrame:
    return df.groupBy(*keys).agg(
        F.count("*").alias("n"),
        F.count_if(failed()).alias("n_failed"),
        F.min(from_iso(F.col("event_time"))).alias("first_time"),
        F.max(from_iso(F.col("event_time"))).alias("last_time"),
    )


def distinct(column: str, approximate: bool = False) -> Column:
    """Exact count of distinct values, or a HyperLogLog estimate."""
    return F.approx_count_distinct(column) if approximate else F.countDistinct(column)


def total(column: str = "n", where: Column | None = None) -> Column:
    """Sum of a roll-up count, 0 when nothing qualifies."""
    value = F.col(column) if where is None else F.when(where, F.col(column))
    return F.coalesce(F.sum(value), F.lit(0))
