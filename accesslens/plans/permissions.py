"""Permission changes and role assumptions."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from accesslens.fixed import PERMISSION_EVENTS, SERVICE_DOMAIN, TARGET_FIELDS, TARGET_SEPARATOR, UNKNOWN
from accesslens.functions.events import (
    earliest,
    event_day,
    event_minute,
    failed,
    latest,
    most_recent,
    since_days,
    with_identity,
)
from accesslens.functions.json import json_fields
from accesslens.functions.text import regexp_or_null
from accesslens.plans.rollup import rollup, total


def permission_changes(df: DataFrame, as_of: dt.date | None = None, days: int = 90, limit: int = 100) -> DataFrame:
    rows = since_days(df, as_of, days).where(F.col("event_name").isin(PERMISSION_EVENTS))
    # Only the rows that stay are parsed.
    kept = json_fields(most_recent(rows, limit), {f"_{key}": key for key in TARGET_FIELDS})
    parts = [F.nullif(F.col(f"_{key}"), F.lit("")) for key in TARGET_FIELDS]
    target = F.when(F.col("request_parameters") != "null", F.concat_ws(TARGET_SEPARATOR, *parts)).otherwise("N/A")
    return kept.select(
        "event_time", "user_name", "event_name", target.alias("target_resource"), "source_ip", "error_code"
    )


def _assumptions(df: DataFrame, as_of: dt.date | None, days: int, extra: dict[str, str] | None = None) -> DataFrame:
    rows = since_days(df, as_of, days).where(F.col("event_name") == "AssumeRole")
    # Replaces the lake's lifted column: there '' stands for a missing ARN.
    return json_fields(rows.drop("role_arn"), {"role_arn": "roleArn", **(extra or {})}).where(
        F.col("role_arn").isNotNull()
    )


def role_assumptions(
    df: DataFrame, as_of: dt.date | None = None, days: int = 90, limit: int = 50, more_than: int = 5
) -> DataFrame:
    user = F.col("user_name")
    assumed_by = (
        F.when(
            user == UNKNOWN,
            F.coalesce(F.replace(F.col("user_agent"), F.lit(SERVICE_DOMAIN), F.lit("")), "_session", F.lit("AWS Service")),
        )
        .when(F.length(user) > 20, F.concat(F.substring(user, 1, 15), F.lit("...")))
        .when(user.contains(":"), F.regexp_extract(user, ":(.*)", 1))
        .otherwise(user)
    )
    return (
        _assumptions(df, as_of, days, {"_session": "roleSessionName"})
        .groupBy(
            regexp_or_null(F.col("role_arn"), "role/([^/]+)$").alias("role_name"),
            assumed_by.alias("assumed_by"),
        )
        .agg(F.count("*").alias("assumption_count"), F.count_if(failed()).alias("failed_assumptions"))
        .where(F.col("assumption_count") > more_than)
        .orderBy(F.desc("assumption_count"), F.asc_nulls_last("role_name"), F.asc_nulls_last("assumed_by"))
        .limit(limit)
    )


def role_assumptions_sql(df: DataFrame, as_of: dt.date | None = None, days: int = 90, limit: int = 100) -> DataFrame:
    rows = with_identity(_assumptions(df, as_of, days), "assumed_by")
    return (
        rollup(rows, "role_arn", "assumed_by", event_day().alias("day"))
        .groupBy("role_arn", "assumed_by")
        .agg(
            total().alias("total_assumptions"),
            F.count("*").alias("unique_days"),
            event_minute(earliest(F.col("first_time"))).alias("first_assumption"),
            event_minute(latest(F.col("last_time"))).alias("last_assumption"),
            total("n_failed").alias("failed_assumptions"),
        )
        .orderBy(F.desc("total_assumptions"), F.asc_nulls_last("role_arn"), F.asc_nulls_last("assumed_by"))
        .limit(limit)
    )


def assumption_summary(role_assumption_rows: DataFrame) -> DataFrame:
    """One summary row over the result of ``role_assumptions``."""
    return role_assumption_rows.agg(
        F.count("*").alias("result_rows"),
        F.coalesce(F.sum("assumption_count"), F.lit(0)).alias("total_assumptions"),
        F.countDistinct(F.coalesce("role_name", F.lit(""))).alias("unique_roles"),
    )
