"""Single-sign-on administration."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from accesslens.fixed import (
    APPLICATION_EVENTS,
    APPLICATION_STATUS_EVENT,
    ASSIGNMENT_EVENTS,
    CRITICAL_POLICIES,
    HIDDEN_NAME,
    PERMISSION_SET_EVENTS,
    POLICY_ATTACH_EVENT,
    SSO_ADMIN_EVENTS,
)
from accesslens.functions.events import earliest, failed, latest, most_recent, percentage, since_days
from accesslens.functions.json import holds_variant, json_fields
from accesslens.functions.text import last_chars_or_empty, regexp_or_null


def _latest(
    df: DataFrame, as_of: dt.date | None, days: int, names: list[str], limit: int, fields: dict[str, str]
) -> DataFrame:
    """Newest events of these names; JSON texts are parsed for the rows that stay."""
    rows = since_days(df, as_of, days).where((F.col("event_type") == "sso") & F.col("event_name").isin(names))
    if holds_variant(df):
        return most_recent(json_fields(rows, fields), limit)
    return json_fields(most_recent(rows, limit), fields)


def _set_suffix() -> Column:
    return last_chars_or_empty(F.col("permission_set_arn"), 16)


def permission_sets(df: DataFrame, as_of: dt.date | None = None, days: int = 30, limit: int = 100) -> DataFrame:
    return permission_sets_sql(df, as_of, days, limit).drop("session_duration")


def permission_sets_sql(df: DataFrame, as_of: dt.date | None = None, days: int = 30, limit: int = 100) -> DataFrame:
    fields = {"permission_set_name": "name", "session_duration": "sessionDuration", "description": "description"}
    return _latest(df, as_of, days, PERMISSION_SET_EVENTS, limit, fields).select(
        "event_time", "user_name", "event_name", *fields, "aws_region", "error_code"
    )


_ASSIGNMENT_FIELDS = {
    "principal_id": "principalId",
    "principal_type": "principalType",
    "target_account_id": "targetId",
    "permission_set_arn": "permissionSetArn",
}


def account_assignments(df: DataFrame, as_of: dt.date | None = None, days: int = 30, limit: int = 100) -> DataFrame:
    return _latest(df, as_of, days, ASSIGNMENT_EVENTS, limit, _ASSIGNMENT_FIELDS).select(
        "user_name",
        "event_name",
        F.regexp_replace("target_account_id", "[^0-9]", "").alias("account_id"),
        F.concat(F.lit("ps-"), _set_suffix()).alias("permission_set"),
        "event_time",
    )


def account_assignments_json(
    df: DataFrame, as_of: dt.date | None = None, days: int = 30, limit: int = 100
) -> DataFrame:
    return _latest(df, as_of, days, ASSIGNMENT_EVENTS, limit, _ASSIGNMENT_FIELDS).select(
        "event_time", "user_name", "event_name", *_ASSIGNMENT_FIELDS, "request_parameters", "response_elements",
        "aws_region", "source_ip", "user_agent", "error_code", "error_message",
    )


def account_assignments_sql(
    df: DataFrame, as_of: dt.date | None = None, days: int = 30, limit: int = 100
) -> DataFrame:
    return _latest(df, as_of, days, ASSIGNMENT_EVENTS, limit, _ASSIGNMENT_FIELDS).select(
        "event_time", "user_name", "event_name", *_ASSIGNMENT_FIELDS, "aws_region", "error_code"
    )


def _policy_attachments(df: DataFrame, as_of: dt.date | None, days: int, limit: int) -> DataFrame:
    # The lake's own policy_arn holds another JSON key.
    fields = {"policy_arn": "managedPolicyArn", "permission_set_arn": "permissionSetArn"}
    return _latest(df.drop("policy_arn"), as_of, days, [POLICY_ATTACH_EVENT], limit, fields)


def admin_policies(df: DataFrame, as_of: dt.date | None = None, days: int = 30, limit: int = 100) -> DataFrame:
    return _policy_attachments(df, as_of, days, limit).select(
        "user_name",
        regexp_or_null(F.col("policy_arn"), "[^/]+$", 0).alias("policy"),
        F.concat(F.lit("ps-"), _set_suffix()).alias("permission_set"),
        "event_time",
    )


def admin_policies_full(df: DataFrame, as_of: dt.date | None = None, days: int = 30, limit: int = 100) -> DataFrame:
    critical = F.col("policy_arn").rlike("|".join(CRITICAL_POLICIES))
    return _policy_attachments(df, as_of, days, limit).select(
        "event_time",
        "user_name",
        "event_name",
        "policy_arn",
        _set_suffix().alias("permission_set_id"),
        F.when(critical, "CRITICAL").otherwise("NORMAL").alias("risk_level"),
        "aws_region",
        "error_code",
    )


def applications(df: DataFrame, as_of: dt.date | None = None, days: int = 30, limit: int = 100) -> DataFrame:
    fields = {
        "application_name": "displayName",
        "template_id": "templateId",
        "start_url": "startUrl",
        "client_id": "clientId",
    }
    shown = F.when(F.col("application_name") == HIDDEN_NAME, "Unknown Application").otherwise(F.col("application_name"))
    return (
        _latest(df, as_of, days, APPLICATION_EVENTS, limit, fields)
        .withColumn("application_name", shown)
        .select("event_time", "user_name", "event_name", *fields, "aws_region", "error_code")
    )


def applications_sql(df: DataFrame, as_of: dt.date | None = None, days: int = 90, limit: int = 100) -> DataFrame:
    fields = {
        "_name": "applicationName",
        "_instance": "managedApplicationInstanceId",
        "_arn": "applicationArn",
        "_id": "applicationId",
        "status": "status",
    }
    identifier = (
        F.when(F.col("event_name") == APPLICATION_EVENTS[0], F.col("_name"))
        .when(F.col("event_name") == APPLICATION_EVENTS[1], F.col("_instance"))
        .otherwise(F.coalesce("_arn", "_id"))
    )
    names = [*APPLICATION_EVENTS, APPLICATION_STATUS_EVENT]
    return _latest(df, as_of, days, names, limit, fields).select(
        "event_time", "user_name", "event_name", identifier.alias("application_identifier"), "status",
        "aws_region", "error_code",
    )


def admin_users_full(df: DataFrame, as_of: dt.date | None = None, days: int = 90, limit: int = 50) -> DataFrame:
    name = F.col("event_name")
    rows = since_days(df, as_of, days).where(
        (F.col("event_type") == "sso") & name.isin(SSO_ADMIN_EVENTS + APPLICATION_EVENTS)
    )
    return (
        rows.groupBy("user_name")
        .agg(
            F.count("*").alias("total_admin_actions"),
            F.count_if(name == "CreatePermissionSet").alias("permission_sets_created"),
            F.count_if(name == "UpdatePermissionSet").alias("permission_sets_updated"),
            F.count_if(name == POLICY_ATTACH_EVENT).alias("policies_attached"),
            F.count_if(name == "CreateAccountAssignment").alias("assignments_created"),
            F.count_if(name.endswith("ManagedApplicationInstance")).alias("app_changes"),
            F.count_if(failed()).alias("error_count"),
            earliest().alias("first_admin_action"),
            latest().alias("last_admin_action"),
        )
        .orderBy(F.desc("total_admin_actions"), F.asc_nulls_last("user_name"))
        .limit(limit)
    )


def admin_users(df: DataFrame, as_of: dt.date | None = None, days: int = 90, limit: int = 50) -> DataFrame:
    return admin_users_full(df, as_of, days, limit).drop("first_admin_action")


def _by_event(df: DataFrame, as_of: dt.date | None, days: int, limit: int, category: Column) -> DataFrame:
    return (
        since_days(df, as_of, days)
        .where(F.col("event_type") == "sso")
        .groupBy("event_name")
        .agg(
            F.count("*").alias("event_count"),
            F.countDistinct("user_name").alias("unique_users"),
            F.count_if(failed()).alias("error_count"),
        )
        .withColumn("error_rate_pct", percentage(F.col("error_count"), F.col("event_count")))
        .withColumn("activity_category", category)
        .orderBy(F.desc("event_count"), F.asc_nulls_last("event_name"))
        .limit(limit)
    )


def activity_summary(df: DataFrame, as_of: dt.date | None = None, days: int = 30, limit: int = 20) -> DataFrame:
    category = (
        F.when(F.col("event_name").isin(SSO_ADMIN_EVENTS), "ADMINISTRATIVE")
        .when(F.col("event_name").isin(APPLICATION_EVENTS), "APPLICATION_MGMT")
        .otherwise("OPERATIONAL")
    )
    return _by_event(df, as_of, days, limit, category)


def activity_summary_sql(df: DataFrame, as_of: dt.date | None = None, days: int = 30, limit: int = 100) -> DataFrame:
    category = F.when(F.col("event_name").isin(SSO_ADMIN_EVENTS), "ADMINISTRATIVE").otherwise("OPERATIONAL")
    return _by_event(df, as_of, days, limit, category)
