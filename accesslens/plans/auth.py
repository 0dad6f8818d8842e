"""Sign-in failures, root use and off-hours activity."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from accesslens.fixed import ROOT, SERVICE_DOMAIN, SIGN_IN_EVENTS
from accesslens.functions.events import (
    earliest,
    event_day,
    event_hour,
    failed,
    known_user,
    latest,
    most_recent,
    since_days,
    with_identity,
)
from accesslens.functions.text import not_blank


def _failures(df: DataFrame, error: str) -> DataFrame:
    """Failure counts, most frequent first; every group key settles ties."""
    return (
        df.groupBy("event_date", "user_name", "source_ip", "event_name", error)
        .agg(F.count("*").alias("failure_count"))
        .orderBy(
            F.desc("failure_count"),
            F.desc_nulls_last("event_date"),
            *[F.asc_nulls_last(key) for key in ("user_name", "source_ip", "event_name", error)],
        )
    )


def failed_auth(df: DataFrame, as_of: dt.date | None = None, days: int = 7, limit: int = 100) -> DataFrame:
    signing_in = F.col("event_name").isin(SIGN_IN_EVENTS) | (F.col("event_source") == "signin.amazonaws.com")
    rows = (
        since_days(df, as_of, days, column="event_date")
        .where(not_blank(F.col("error_code")) | not_blank(F.col("error_message")))
        .where(signing_in)
        .withColumn("error", F.coalesce("error_code", "error_message"))
    )
    return _failures(rows, "error").limit(limit)


def failed_auth_sql(
    df: DataFrame, as_of: dt.date | None = None, days: int = 7, limit: int | None = 100
) -> DataFrame:
    rows = (
        since_days(df, as_of, days)
        .where(failed() & F.col("event_name").isin(SIGN_IN_EVENTS))
        .withColumn("event_date", event_day())
    )
    counts = _failures(rows, "error_code")
    return counts if limit is None else counts.limit(limit)


def root_usage(df: DataFrame, as_of: dt.date | None = None, days: int = 90, limit: int = 100) -> DataFrame:
    rows = since_days(df, as_of, days).where(F.lower("user_name") == ROOT)
    return most_recent(rows, limit).select(
        "event_time", "event_name", "user_name", "source_ip", "user_agent", "aws_region", "request_parameters"
    )


def root_usage_sql(df: DataFrame, as_of: dt.date | None = None, days: int = 30, limit: int = 100) -> DataFrame:
    rows = since_days(df, as_of, days).where(F.col("user_name").contains(ROOT))
    return most_recent(rows, limit).select(
        "event_time", "event_name", "source_ip", "user_agent", "aws_region", "error_code",
        "request_parameters", "response_elements",
    )


def _off_hours(
    df: DataFrame, as_of: dt.date | None, days: int, limit: int, day_starts: int, day_ends: int, full: bool
) -> DataFrame:
    rows = (
        since_days(df, as_of, days)
        .where((event_hour() < day_starts) | (event_hour() > day_ends))
        .where(known_user() & ~F.col("source_ip").endswith(SERVICE_DOMAIN))
    )
    first = [earliest().alias("first_occurrence")] if full else []
    return (
        with_identity(rows)
        .groupBy("user_identity", "event_name")
        .agg(F.count("*").alias("event_count"), *first, latest().alias("last_occurrence"))
        .orderBy(F.asc_nulls_last("user_identity"), F.desc("event_count"), F.asc_nulls_last("event_name"))
        .limit(limit)
    )


def off_hours(
    df: DataFrame, as_of: dt.date | None = None, days: int = 90, limit: int = 100,
    day_starts: int = 6, day_ends: int = 22,
) -> DataFrame:
    """Hours before ``day_starts`` and after ``day_ends``; 22:xx still counts as day."""
    return _off_hours(df, as_of, days, limit, day_starts, day_ends, full=False)


def off_hours_full(
    df: DataFrame, as_of: dt.date | None = None, days: int = 90, limit: int = 100,
    day_starts: int = 6, day_ends: int = 22,
) -> DataFrame:
    return _off_hours(df, as_of, days, limit, day_starts, day_ends, full=True)
