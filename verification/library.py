"""Registered callables for the query library."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from accesslens import run
from accesslens.plans.permissions import assumption_summary
from verification.recipe import AS_OF, events_from

# Registered name -> (query name, variant).
LIBRARY = {
    "q01_user_lookup_table": ("user_lookup", "table"),
    "q01_user_lookup_full": ("user_lookup", "full"),
    "q02_failed_auth": ("failed_auth", "full"),
    "q02_failed_auth_sql": ("failed_auth", "sql"),
    "q03_root_usage": ("root_usage", "full"),
    "q03_root_usage_sql": ("root_usage", "sql"),
    "q04_off_hours_table": ("off_hours", "table"),
    "q04_off_hours_full": ("off_hours", "full"),
    "q05_active_users_table": ("active_users", "table"),
    "q05_active_users_full": ("active_users", "full"),
    "q06_permission_changes": ("permission_changes", "full"),
    "q07_role_assumptions": ("role_assumptions", "full"),
    "q07_role_assumptions_sql": ("role_assumptions", "sql"),
    "q08_daily_summary": ("daily_summary", "full"),
    "q08_daily_summary_sql": ("daily_summary", "sql"),
    "q09_hourly_activity": ("hourly_activity", "full"),
    "q09_hourly_activity_sql": ("hourly_activity", "sql"),
    "q10_sso_permission_sets": ("sso_permission_sets", "full"),
    "q10_sso_permission_sets_sql": ("sso_permission_sets", "sql"),
    "q11_sso_account_assignments_table": ("sso_account_assignments", "table"),
    "q11_sso_account_assignments_json": ("sso_account_assignments", "json"),
    "q11_sso_account_assignments_sql": ("sso_account_assignments", "sql"),
    "q12_sso_admin_policies_table": ("sso_admin_policies", "table"),
    "q12_sso_admin_policies_full": ("sso_admin_policies", "full"),
    "q13_sso_applications": ("sso_applications", "full"),
    "q13_sso_applications_sql": ("sso_applications", "sql"),
    "q14_sso_admin_users_table": ("sso_admin_users", "table"),
    "q14_sso_admin_users_full": ("sso_admin_users", "full"),
    "q15_sso_activity_summary": ("sso_activity_summary", "full"),
    "q15_sso_activity_summary_sql": ("sso_activity_summary", "sql"),
    "q16_table_statistics": ("table_statistics", "full"),
    "q17_adhoc_failed_auth": ("adhoc_failed_auth", "full"),
    "q18_adhoc_permission_changes_by_user": ("adhoc_permission_changes_by_user", "full"),
    "q19_adhoc_role_assumptions": ("adhoc_role_assumptions", "full"),
}


def _query(name: str, variant: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: run(name, events_from(spark, sf_dir), AS_OF, variant)


def _role_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assumption_summary(run("role_assumptions", events_from(spark, sf_dir), AS_OF))


def _null_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Failures of events some of which have no user or address."""
    number = F.col("event_id").cast("long")
    gone = {name: F.when(number % step != 0, F.col(name)) for name, step in (("user_name", 3), ("source_ip", 5))}
    return run("failed_auth", events_from(spark, sf_dir).withColumns(gone), AS_OF, "full")


LIBRARY_QUERIES = {key: _query(*target) for key, target in LIBRARY.items()} | {"q07_summary": _role_summary, "q02_null_sort_keys": _null_keys}
