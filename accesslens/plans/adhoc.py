"""Ad-hoc investigation queries."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from accesslens.fixed import ADHOC_PERMISSION_EVENTS
from accesslens.functions.events import event_date, failed, since_days
from accesslens.plans.auth import failed_auth_sql
from accesslens.plans.permissions import _assumptions


def recent_failures(df: DataFrame, as_of: dt.date | None = None, days: int = 7) -> DataFrame:
    return failed_auth_sql(df, as_of, days, limit=None)


def permission_changes_by_user(df: DataFrame, as_of: dt.date | None = None, days: int = 30) -> DataFrame:
    return (
        since_days(df, as_of, days)
        .where(F.col("event_name").isin(ADHOC_PERMISSION_EVENTS))
        .groupBy("user_name", "event_name")
        .agg(
            F.count("*").alias("change_count"),
            F.min(event_date()).cast("string").alias("first_change"),
            F.max(event_date()).cast("string").alias("last_change"),
        )
        .orderBy(F.desc("change_count"), F.asc_nulls_last("user_name"), F.asc_nulls_last("event_name"))
    )


def role_assumption_counts(df: DataFrame, as_of: dt.date | None = None, days: int = 30, limit: int = 20) -> DataFrame:
    return (
        _assumptions(df, as_of, days)
        .groupBy("role_arn", "user_name")
        .agg(F.count("*").alias("assumption_count"), F.count_if(failed()).alias("failed_count"))
        .orderBy(F.desc("assumption_count"), F.asc_nulls_last("role_arn"), F.asc_nulls_last("user_name"))
        .limit(limit)
    )
