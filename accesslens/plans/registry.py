"""The query library by name and variant."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from accesslens.plans import activity, adhoc, auth, permissions, sso, users


@dataclass(frozen=True)
class Query:
    """A named query; ``table``, ``full``, ``json`` and ``sql`` are its forms."""

    description: str
    variants: dict[str, Callable[..., DataFrame]]

    def choose(self, variant: str | None, output: str) -> Callable[..., DataFrame]:
        if variant is not None:
            if variant not in self.variants:
                raise ValueError(f"Unknown variant: {variant}. Available: {sorted(self.variants)}")
            return self.variants[variant]
        preferred = ["json", "table", "full"] if output == "json" else ["table", "full"]
        return next(self.variants[name] for name in preferred if name in self.variants)


QUERIES: dict[str, Query] = {
    "user_lookup": Query(
        "First and last activity and event count per acting user",
        {"table": users.user_lookup, "full": users.user_lookup_full, "sql": users.user_lookup_full},
    ),
    "failed_auth": Query(
        "Failed sign-ins and role assumptions by user, address and error",
        {"full": auth.failed_auth, "sql": auth.failed_auth_sql},
    ),
    "root_usage": Query(
        "Every recent action of the root account",
        {"full": auth.root_usage, "sql": auth.root_usage_sql},
    ),
    "off_hours": Query(
        "Actions outside working hours per user",
        {"table": auth.off_hours, "full": auth.off_hours_full, "sql": auth.off_hours_full},
    ),
    "active_users": Query(
        "Users with the most actions, with their errors",
        {"table": users.active_users, "full": users.active_users_full, "sql": users.active_users_full},
    ),
    "permission_changes": Query(
        "Latest changes to users, roles, groups and their policies",
        {"full": permissions.permission_changes, "sql": permissions.permission_changes},
    ),
    "role_assumptions": Query(
        "Which roles are assumed, how often and by whom",
        {"full": permissions.role_assumptions, "sql": permissions.role_assumptions_sql},
    ),
    "daily_summary": Query(
        "Events, users, actions and failures per day",
        {"full": activity.daily_summary, "sql": activity.daily_summary_sql},
    ),
    "hourly_activity": Query(
        "Events and error rate per hour of the day",
        {"full": activity.hourly_activity, "sql": activity.hourly_activity_sql},
    ),
    "sso_permission_sets": Query(
        "Latest permission sets created or changed",
        {"full": sso.permission_sets, "sql": sso.permission_sets_sql},
    ),
    "sso_account_assignments": Query(
        "Latest account assignments granted or removed",
        {
            "table": sso.account_assignments,
            "json": sso.account_assignments_json,
            "sql": sso.account_assignments_sql,
        },
    ),
    "sso_admin_policies": Query(
        "Latest managed policies attached to permission sets",
        {"table": sso.admin_policies, "full": sso.admin_policies_full, "sql": sso.admin_policies_full},
    ),
    "sso_applications": Query(
        "Latest application instances added or removed",
        {"full": sso.applications, "sql": sso.applications_sql},
    ),
    "sso_admin_users": Query(
        "Users who make administrative single-sign-on changes",
        {"table": sso.admin_users, "full": sso.admin_users_full, "sql": sso.admin_users_full},
    ),
    "sso_activity_summary": Query(
        "Single-sign-on events with error rate and category",
        {"full": sso.activity_summary, "sql": sso.activity_summary_sql},
    ),
    "table_statistics": Query("Totals and time range of the table", {"full": activity.table_statistics}),
    "adhoc_failed_auth": Query("Failed sign-ins, all groups", {"full": adhoc.recent_failures}),
    "adhoc_permission_changes_by_user": Query(
        "Permission changes per user and action", {"full": adhoc.permission_changes_by_user}
    ),
    "adhoc_role_assumptions": Query("Role assumptions per role and user", {"full": adhoc.role_assumption_counts}),
}


def run(
    name: str,
    df: DataFrame,
    as_of: dt.date | None = None,
    variant: str | None = None,
    output: str = "table",
    **params,
) -> DataFrame:
    """Build the named query over an event table or lake.

    Without ``variant`` the JSON form is used for ``output='json'`` where one
    exists, then the short table form, then the full form.
    """
    if name not in QUERIES:
        raise ValueError(f"Unknown query: {name}. Available queries: {list(QUERIES)}")
    return QUERIES[name].choose(variant, output)(df, as_of, **params)


def catalogue(spark: SparkSession) -> DataFrame:
    """Names, descriptions and variants of all queries."""
    rows = [(name, query.description, sorted(query.variants)) for name, query in QUERIES.items()]
    return spark.createDataFrame(rows, "name string, description string, variants array<string>")
