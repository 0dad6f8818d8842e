"""Predicates and expressions shared by the query library."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from accesslens.fixed import UNKNOWN
from accesslens.functions.json import json_fields
from accesslens.functions.text import not_blank, regexp_or_null
from accesslens.functions.time import from_iso, iso


def failed() -> Column:
    return not_blank(F.col("error_code"))


def known_user() -> Column:
    return F.col("user_name") != UNKNOWN


def event_day() -> Column:
    return F.substring("event_time", 1, 10)


def event_minute(time: Column) -> Column:
    return F.substring(time, 1, 16)


def event_date() -> Column:
    return event_day().try_cast("date")


def earliest(time: Column | None = None) -> Column:
    """ISO text of the first event time.

    Stored times sort alike as text and as timestamps; a minimum over text
    would sort all rows, one over timestamps aggregates by hash.
    """
    return iso(F.min(from_iso(F.col("event_time")) if time is None else time))


def latest(time: Column | None = None) -> Column:
    """ISO text of the last event time."""
    return iso(F.max(from_iso(F.col("event_time")) if time is None else time))


def event_hour() -> Column:
    return F.substring("event_time", 12, 2).try_cast("int")


def since_days(df: DataFrame, as_of: dt.date | None, days: int, column: str = "event_time") -> DataFrame:
    """Rows of the last ``days`` days before ``as_of`` (default: today).

    Comparing the ISO text with the start day selects the same rows as
    comparing its first ten characters, and reaches the Parquet statistics.
    On a date-partitioned table the partition columns are restricted too.
    """
    if as_of is None:
        start = F.date_sub(F.current_date(), days)
    else:
        start = F.lit(as_of - dt.timedelta(days=days))
    keep = F.col(column) >= start.cast("string")
    if {"year", "month", "day"} <= set(df.columns):
        year, month, day = F.year(start), F.month(start), F.day(start)
        same_year, same_month = F.col("year") == year, F.col("month") == month
        keep &= (
            (F.col("year") > year)
            | (same_year & (F.col("month") > month))
            | (same_year & same_month & (F.col("day") >= day))
        )
    return df.where(keep)


def with_identity(df: DataFrame, name: str = "user_identity") -> DataFrame:
    """Add who acted: session part of the user name, session name, user name.

    The lake stores this column, so lake queries need neither the JSON text
    nor the pattern.
    """
    if "user_identity" in df.columns:
        return df if name == "user_identity" else df.withColumn(name, F.col("user_identity"))
    user = F.col("user_name")
    session_in_name = F.when(user.contains(":"), regexp_or_null(user, ":(.+)$"))
    params = F.col("request_parameters")
    may_hold_key = params.contains("roleSessionName") | params.contains("\\u")
    return (
        json_fields(df, {"_session": "roleSessionName"}, guard=may_hold_key & session_in_name.isNull())
        .withColumn(name, F.coalesce(session_in_name, F.col("_session"), F.col("user_name")))
        .drop("_session")
    )


def percentage(part: Column, whole: Column) -> Column:
    """Share in percent with two decimals, rounded exactly, as a double."""
    hundred = F.lit(100).cast("decimal(4,1)")
    return F.round(hundred * part / whole, 2).cast("double")


def most_recent(df: DataFrame, limit: int) -> DataFrame:
    """Newest rows first; the event id settles ties."""
    return df.orderBy(F.desc("event_time"), F.asc("event_id")).limit(limit)
