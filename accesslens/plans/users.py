"""Who did what: user look-up and most active users."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from accesslens.functions.events import (
    earliest,
    event_day,
    event_minute,
    failed,
    known_user,
    latest,
    since_days,
    with_identity,
)
from accesslens.plans.rollup import distinct, rollup, total


def _acting_users(df: DataFrame, as_of: dt.date | None, days: int) -> DataFrame:
    return with_identity(since_days(df, as_of, days).where(known_user()))


def _span(first: str | None = None, last: str | None = None) -> list[Column]:
    return [
        event_minute(earliest(first and F.col(first))).alias("first_activity"),
        event_minute(latest(last and F.col(last))).alias("last_activity"),
    ]


def user_lookup(df: DataFrame, as_of: dt.date | None = None, days: int = 30, limit: int = 25) -> DataFrame:
    return (
        _acting_users(df, as_of, days)
        .groupBy("user_identity")
        .agg(*_span(), F.count("*").alias("total_events"))
        .orderBy(F.desc("total_events"), F.asc_nulls_last("user_identity"))
        .limit(limit)
    )


def user_lookup_full(
    df: DataFrame, as_of: dt.date | None = None, days: int = 30, limit: int = 25, approximate: bool = False
) -> DataFrame:
    return (
        rollup(_acting_users(df, as_of, days), "user_identity", "event_name", event_day().alias("day"))
        .groupBy("user_identity")
        .agg(
            *_span("first_time", "last_time"),
            total().alias("total_events"),
            distinct("event_name", approximate).alias("unique_actions"),
            distinct("day", approximate).alias("days_active"),
        )
        .orderBy(F.desc("total_events"), F.asc_nulls_last("user_identity"))
        .limit(limit)
    )


def active_users(df: DataFrame, as_of: dt.date | None = None, days: int = 30, limit: int = 30) -> DataFrame:
    return (
        _acting_users(df, as_of, days)
        .groupBy("user_identity")
        .agg(
            F.count("*").alias("total_actions"),
            *_span(),
            F.count_if(failed()).alias("error_count"),
        )
        .orderBy(F.desc("total_actions"), F.asc_nulls_last("user_identity"))
        .limit(limit)
    )


def active_users_full(
    df: DataFrame, as_of: dt.date | None = None, days: int = 30, limit: int = 30, approximate: bool = False
) -> DataFrame:
    return (
        rollup(_acting_users(df, as_of, days), "user_identity", "event_name", event_day().alias("day"))
        .groupBy("user_identity")
        .agg(
            total().alias("total_actions"),
            distinct("event_name", approximate).alias("unique_actions"),
            distinct("day", approximate).alias("active_days"),
            *_span("first_time", "last_time"),
            total("n_failed").alias("error_count"),
        )
        .orderBy(F.desc("total_actions"), F.asc_nulls_last("user_identity"))
        .limit(limit)
    )
