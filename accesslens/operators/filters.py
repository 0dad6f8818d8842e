"""Noise: service-linked role activity and configured scanner roles."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from accesslens.fixed import SERVICE_DOMAIN, SERVICE_ROLE_PATH
from accesslens.functions.json import once
from accesslens.functions.text import not_blank

SERVICE = "service"
ROLE = "role"


def service_linked() -> Column:
    """Service-linked role activity of parsed records; never NULL."""
    from_service = F.coalesce(F.col("user_agent").endswith(SERVICE_DOMAIN), F.lit(False)) | F.coalesce(
        F.col("source_ip").endswith(SERVICE_DOMAIN), F.lit(False)
    )
    return F.coalesce(F.col("issuer_arn").contains(SERVICE_ROLE_PATH), F.lit(False)) | F.coalesce(
        (F.col("identity_type") == "AWSService") & from_service & F.col("role_arn").contains(SERVICE_ROLE_PATH),
        F.lit(False),
    )


def role_pattern(roles: str | list[str] | None) -> str | None:
    """One case-insensitive pattern for a comma list of role names and ARNs.

    ``*`` is a wildcard.  An ARN has to match as a whole; a name has to fill
    the text between slashes or the ends of the text.
    """
    names = roles.split(",") if isinstance(roles, str) else list(roles or [])
    choices = []
    for name in filter(None, (item.strip() for item in names)):
        body = ".*".join(re.escape(part) for part in name.split("*"))
        is_arn = name.startswith("arn:aws:iam::")
        choices.append(f"^{body}$" if is_arn else f"(?:^|/){body}(?:/|$)")
    return "(?iu)" + "|".join(choices) if choices else None


def filtered_role(roles: str | list[str] | None) -> Column:
    """Matches a filtered role by assumed role ARN or user name; never NULL."""
    pattern = role_pattern(roles)
    if pattern is None:
        return F.lit(False)
    user = F.col("user_name")
    assumes = (F.col("event_name") == "AssumeRole") & not_blank(F.col("role_arn")) & F.col("role_arn").rlike(pattern)
    return F.coalesce(assumes, F.lit(False)) | F.coalesce(not_blank(user) & user.rlike(pattern), F.lit(False))


def flag_noise(df: DataFrame, drop_services: bool = True, roles: str | list[str] | None = None) -> DataFrame:
    """Add the noise reasons to ``drop_reason`` of parsed records."""
    reason = F.when(F.lit(drop_services) & service_linked(), SERVICE).when(filtered_role(roles), ROLE)
    return df.withColumn("drop_reason", F.coalesce("drop_reason", reason))


def filter_events(df: DataFrame, roles: str | list[str] | None) -> DataFrame:
    """Apply the role filter to rows of the event table."""
    arn = F.when(F.col("event_name") == "AssumeRole", F.get_json_object("request_parameters", "$.roleArn"))
    return df.drop("role_arn").select("*", once(arn).alias("role_arn")).where(~filtered_role(roles)).select(df.columns)
