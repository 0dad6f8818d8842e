"""Daily and hourly summaries and table statistics."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from accesslens.functions.events import earliest, event_day, event_hour, failed, latest, percentage, since_days
from accesslens.plans.rollup import distinct, rollup, total


def _by_day(
    df: DataFrame, as_of: dt.date | None, days: int, measures: list[Column], approximate: bool
) -> DataFrame:
    daily = rollup(since_days(df, as_of, days), event_day().alias("activity_date"), "user_name", "event_name")
    return (
        daily.groupBy("activity_date")
        .agg(
            total().alias("total_events"),
            distinct("user_name", approximate).alias("unique_users"),
            distinct("event_name", approximate).alias("unique_actions"),
            *measures,
        )
        .orderBy(F.desc_nulls_last("activity_date"))
    )


def daily_summary(
    df: DataFrame, as_of: dt.date | None = None, days: int = 90, limit: int = 30, approximate: bool = False
) -> DataFrame:
    name = F.lower("event_name")
    measures = [
        total("n_failed").alias("failed_events"),
        total(where=name.contains("create") & name.contains("user")).alias("users_created"),
        total(where=name.contains("delete") & name.contains("user")).alias("users_deleted"),
        total(where=name.contains("policy")).alias("policy_changes"),
        total(where=name.contains("assume")).alias("role_assumptions"),
    ]
    return _by_day(df, as_of, days, measures, approximate).limit(limit)


def daily_summary_sql(
    df: DataFrame, as_of: dt.date | None = None, days: int = 30, approximate: bool = False
) -> DataFrame:
    name = F.col("event_name")
    measures = [
        total("n_failed").alias("error_events"),
        total(where=name.startswith("Create")).alias("create_actions"),
        total(where=name.startswith("Delete")).alias("delete_actions"),
        total(where=name.startswith("Update") | name.startswith("Put")).alias("modify_actions"),
        total(where=name == "AssumeRole").alias("role_assumptions"),
    ]
    return _by_day(df, as_of, days, measures, approximate).select(
        "activity_date", "unique_users", "total_events", "error_events", "unique_actions",
        "create_actions", "delete_actions", "modify_actions", "role_assumptions",
    )


def hourly_activity(
    df: DataFrame,
    as_of: dt.date | None = None,
    days: int = 7,
    count_name: str = "total_events",
    approximate: bool = False,
) -> DataFrame:
    return (
        since_days(df, as_of, days)
        .groupBy(event_hour().alias("hour_of_day"))
        .agg(
            F.count("*").alias(count_name),
            distinct("user_name", approximate).alias("active_users"),
            F.count_if(failed()).alias("error_events"),
        )
        .withColumn("error_rate_pct", percentage(F.col("error_events"), F.col(count_name)))
        .orderBy(F.asc_nulls_last("hour_of_day"))
    )


def hourly_activity_sql(
    df: DataFrame, as_of: dt.date | None = None, days: int = 7, approximate: bool = False
) -> DataFrame:
    return hourly_activity(df, as_of, days, "event_count", approximate)


def table_statistics(df: DataFrame, as_of: dt.date | None = None, approximate: bool = False) -> DataFrame:
    """Totals over the whole table; ``as_of`` is accepted and not needed."""
    return rollup(df, "user_name", "event_name", "event_date").agg(
        total().alias("total_events"),
        distinct("user_name", approximate).alias("unique_users"),
        distinct("event_name", approximate).alias("unique_actions"),
        earliest(F.col("first_time")).alias("earliest_event"),
        latest(F.col("last_time")).alias("latest_event"),
        total("n_failed").alias("error_events"),
        distinct("event_date", approximate).alias("days_with_data"),
    )
