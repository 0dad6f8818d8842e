"""DuckDB statements for the query library.

Every statement starts from the same derived table ``ev``: the recipe's events
plus the expressions the queries share, written out independently.
"""

from __future__ import annotations

from verification import names
from verification.recipe import EVENTS_SQL


def scalar(key: str, text: str = "request_parameters") -> str:
    """A JSON key as text, NULL for objects, arrays, null and missing keys."""
    nested = f"json_type({text}, '$.{key}') IN ('OBJECT', 'ARRAY')"
    return f"(CASE WHEN {nested} THEN NULL ELSE json_extract_string({text}, '$.{key}') END)"


def rate(part: str, whole: str) -> str:
    """Percentage to two decimals, half up, in whole-number arithmetic."""
    return f"CAST(((20000 * {part} + {whole}) // (2 * {whole})) / 100.0 AS DOUBLE)"


def tail16(text: str) -> str:
    return f"(CASE WHEN length({text}) >= 16 THEN right({text}, 16) WHEN {text} IS NOT NULL THEN '' END)"


EV = f"""
WITH iam_events AS ({EVENTS_SQL}),
ev AS (
  SELECT *,
    coalesce(nullif(regexp_extract(user_name, ':(.+)$', 1), ''), {scalar('roleSessionName')}, user_name) AS who,
    coalesce(error_code, '') <> '' AS bad,
    left(event_time, 10) AS day,
    left(event_time, 16) AS minute,
    CAST(event_time[12:13] AS INTEGER) AS hour,
    {scalar('roleArn')} AS arn
  FROM iam_events
)
"""

# First day inside a window of n days before 2024-01-31.
START = {7: "'2024-01-24'", 30: "'2024-01-01'", 90: "'2023-11-02'"}

SIGN_IN = f"event_name IN ({names.SIGN_IN})"
SSO_ADMIN, SSO_APPS, IAM_CHANGES = names.SSO_ADMIN, names.SSO_APPS, names.IAM_CHANGES


def newest(columns: str, condition: str, days: int, source: str = "ev") -> str:
    return (
        f"{EV} SELECT {columns} FROM {source} WHERE day >= {START[days]} AND {condition} "
        "ORDER BY event_time DESC, event_id LIMIT 100"
    )


def users(columns: str, count: str, limit: int) -> str:
    return (
        f"{EV} SELECT who AS user_identity, {columns} count(*) AS {count}, min(minute) AS first_activity, "
        f"max(minute) AS last_activity FROM ev WHERE day >= {START[30]} AND user_name <> 'unknown' "
        f"GROUP BY who ORDER BY {count} DESC, user_identity LIMIT {limit}"
    )


def failures(error: str, condition: str, limit: str) -> str:
    return (
        f"{EV} SELECT event_date, user_name, source_ip, event_name, {error}, count(*) AS failure_count FROM ev "
        f"WHERE day >= {START[7]} AND {condition} GROUP BY ALL "
        f"ORDER BY failure_count DESC, event_date DESC, user_name, source_ip, event_name, 5 {limit}"
    )


def off_hours(extra: str) -> str:
    return (
        f"{EV} SELECT who AS user_identity, event_name, count(*) AS event_count, {extra} "
        f"max(event_time) AS last_occurrence FROM ev WHERE day >= {START[90]} AND NOT hour BETWEEN 6 AND 22 "
        "AND user_name <> 'unknown' AND NOT suffix(source_ip, '.amazonaws.com') "
        "GROUP BY who, event_name ORDER BY user_identity, event_count DESC, event_name LIMIT 100"
    )


def hourly(count: str) -> str:
    return (
        f"{EV}, h AS (SELECT hour, count(*) AS n, count(DISTINCT user_name) AS u, count_if(bad) AS e FROM ev "
        f"WHERE day >= {START[7]} GROUP BY hour) "
        f"SELECT hour AS hour_of_day, n AS {count}, u AS active_users, CAST(e AS BIGINT) AS error_events, "
        f"{rate('e', 'n')} AS error_rate_pct FROM h ORDER BY hour"
    )


def admin_users(extra: str) -> str:
    def made(name: str) -> str:
        return f"count(*) FILTER (event_name = '{name}')"

    return (
        f"{EV} SELECT user_name, count(*) AS total_admin_actions, "
        f"{made('CreatePermissionSet')} AS permission_sets_created, "
        f"{made('UpdatePermissionSet')} AS permission_sets_updated, "
        f"{made('AttachManagedPolicyToPermissionSet')} AS policies_attached, "
        f"{made('CreateAccountAssignment')} AS assignments_created, "
        "count(*) FILTER (suffix(event_name, 'ManagedApplicationInstance')) AS app_changes, "
        f"count(*) FILTER (bad) AS error_count, {extra} max(event_time) AS last_admin_action FROM ev "
        f"WHERE day >= {START[90]} AND event_type = 'sso' AND event_name IN ({SSO_ADMIN}, {SSO_APPS}) "
        "GROUP BY user_name ORDER BY total_admin_actions DESC, user_name LIMIT 50"
    )


def sso_summary(category: str, limit: int) -> str:
    return (
        f"{EV}, s AS (SELECT event_name, count(*) AS n, count(DISTINCT user_name) AS u, count_if(bad) AS e FROM ev "
        f"WHERE day >= {START[30]} AND event_type = 'sso' GROUP BY event_name) "
        "SELECT event_name, n AS event_count, u AS unique_users, CAST(e AS BIGINT) AS error_count, "
        f"{rate('e', 'n')} AS error_rate_pct, CASE WHEN event_name IN ({SSO_ADMIN}) THEN 'ADMINISTRATIVE' {category} "
        f"ELSE 'OPERATIONAL' END AS activity_category FROM s ORDER BY n DESC, event_name LIMIT {limit}"
    )


ROLE_ASSUMPTIONS = f"""{EV},
a AS (
  SELECT nullif(regexp_extract(arn, 'role/([^/]+)$', 1), '') AS role_name, bad,
    CASE WHEN user_name = 'unknown' THEN coalesce(replace(user_agent, '.amazonaws.com', ''),
           {scalar('roleSessionName')}, 'AWS Service')
         WHEN length(user_name) > 20 THEN left(user_name, 15) || '...'
         WHEN contains(user_name, ':') THEN regexp_extract(user_name, ':(.*)', 1)
         ELSE user_name END AS assumed_by
  FROM ev WHERE day >= {START[90]} AND event_name = 'AssumeRole' AND arn IS NOT NULL
),
r AS (
  SELECT role_name, assumed_by, count(*) AS assumption_count, count(*) FILTER (bad) AS failed_assumptions
  FROM a GROUP BY ALL HAVING count(*) > 5
  ORDER BY assumption_count DESC, role_name, assumed_by LIMIT 50
)
"""

DISTINCT_USE = "count(DISTINCT event_name) AS unique_actions, count(DISTINCT day) AS "
SET_FIELDS = f"event_time, user_name, event_name, {scalar('name')} AS permission_set_name, {scalar('description')} AS description, aws_region, error_code"
ASSIGNMENT = "event_type = 'sso' AND event_name IN ('CreateAccountAssignment', 'DeleteAccountAssignment')"
ASSIGNMENT_FIELDS = (
    f"event_time, user_name, event_name, {scalar('principalId')} AS principal_id, {scalar('principalType')} AS "
    f"principal_type, {scalar('targetId')} AS target_account_id, {scalar('permissionSetArn')} AS permission_set_arn, "
    "aws_region, error_code"
)
ATTACHED = "event_type = 'sso' AND event_name = 'AttachManagedPolicyToPermissionSet'"
POLICY = scalar("managedPolicyArn")
TARGETS = ", ".join(f"nullif({scalar(k)}, '')" for k in ("userName", "roleName", "groupName", "policyName", "policyArn"))
DAY_SUMS = "day AS activity_date, count(*) AS total_events, count(DISTINCT user_name) AS unique_users, count(DISTINCT event_name) AS unique_actions, "

QUERY_ORACLES: dict[str, str] = {
    "q01_user_lookup_table": users("", "total_events", 25),
    "q01_user_lookup_full": users(DISTINCT_USE + "days_active,", "total_events", 25),
    "q02_failed_auth": failures(
        "coalesce(error_code, error_message) AS error",
        f"(bad OR coalesce(error_message, '') <> '') AND ({SIGN_IN} OR event_source = 'signin.amazonaws.com')",
        "LIMIT 100",
    ),
    "q02_failed_auth_sql": failures("error_code", f"bad AND {SIGN_IN}", "LIMIT 100"),
    "q03_root_usage": newest(
        "event_time, event_name, user_name, source_ip, user_agent, aws_region, request_parameters",
        "lower(user_name) = 'root'", 90,
    ),
    "q03_root_usage_sql": newest(
        "event_time, event_name, source_ip, user_agent, aws_region, error_code, request_parameters, response_elements",
        "contains(user_name, 'root')", 30,
    ),
    "q04_off_hours_table": off_hours(""),
    "q04_off_hours_full": off_hours("min(event_time) AS first_occurrence,"),
    "q05_active_users_table": users("count(*) FILTER (bad) AS error_count,", "total_actions", 30),
    "q05_active_users_full": users(
        "count(*) FILTER (bad) AS error_count, " + DISTINCT_USE + "active_days,", "total_actions", 30
    ),
    "q06_permission_changes": newest(
        "event_time, user_name, event_name, CASE WHEN coalesce(request_parameters, 'null') = 'null' THEN 'N/A' "
        f"ELSE concat_ws(' → ', {TARGETS}) END AS target_resource, source_ip, error_code",
        f"event_name IN ({IAM_CHANGES})", 90,
    ),
    "q07_role_assumptions": f"{ROLE_ASSUMPTIONS} SELECT * FROM r",
    "q07_role_assumptions_sql": f"""{EV} SELECT arn AS role_arn, who AS assumed_by, count(*) AS total_assumptions,
        count(DISTINCT day) AS unique_days, min(minute) AS first_assumption, max(minute) AS last_assumption,
        count(*) FILTER (bad) AS failed_assumptions
        FROM ev WHERE day >= {START[90]} AND event_name = 'AssumeRole' AND arn IS NOT NULL
        GROUP BY arn, who ORDER BY total_assumptions DESC, role_arn, assumed_by LIMIT 100""",
    "q07_summary": f"""{ROLE_ASSUMPTIONS} SELECT count(*) AS result_rows,
        CAST(coalesce(sum(assumption_count), 0) AS BIGINT) AS total_assumptions,
        count(DISTINCT coalesce(role_name, '')) AS unique_roles FROM r""",
    "q08_daily_summary": f"""{EV} SELECT {DAY_SUMS} count(*) FILTER (bad) AS failed_events,
        count(*) FILTER (event_name ILIKE '%create%' AND event_name ILIKE '%user%') AS users_created,
        count(*) FILTER (event_name ILIKE '%delete%' AND event_name ILIKE '%user%') AS users_deleted,
        count(*) FILTER (event_name ILIKE '%policy%') AS policy_changes,
        count(*) FILTER (event_name ILIKE '%assume%') AS role_assumptions
        FROM ev WHERE day >= {START[90]} GROUP BY day ORDER BY day DESC LIMIT 30""",
    "q08_daily_summary_sql": f"""{EV} SELECT {DAY_SUMS} count(*) FILTER (bad) AS error_events,
        count(*) FILTER (prefix(event_name, 'Create')) AS create_actions,
        count(*) FILTER (prefix(event_name, 'Delete')) AS delete_actions,
        count(*) FILTER (regexp_matches(event_name, '^(Update|Put)')) AS modify_actions,
        count(*) FILTER (event_name = 'AssumeRole') AS role_assumptions
        FROM ev WHERE day >= {START[30]} GROUP BY day ORDER BY day DESC""",
    "q09_hourly_activity": hourly("total_events"),
    "q09_hourly_activity_sql": hourly("event_count"),
    "q10_sso_permission_sets": newest(
        SET_FIELDS, "event_type = 'sso' AND event_name IN ('CreatePermissionSet', 'UpdatePermissionSet')", 30
    ),
    "q10_sso_permission_sets_sql": newest(
        SET_FIELDS + f", {scalar('sessionDuration')} AS session_duration",
        "event_type = 'sso' AND event_name IN ('CreatePermissionSet', 'UpdatePermissionSet')", 30,
    ),
    "q11_sso_account_assignments_table": newest(
        f"user_name, event_name, regexp_replace({scalar('targetId')}, '[^0-9]', '', 'g') AS account_id, "
        f"'ps-' || {tail16(scalar('permissionSetArn'))} AS permission_set, event_time",
        ASSIGNMENT, 30,
    ),
    "q11_sso_account_assignments_json": newest(
        ASSIGNMENT_FIELDS + ", request_parameters, response_elements, source_ip, user_agent, error_message",
        ASSIGNMENT, 30,
    ),
    "q11_sso_account_assignments_sql": newest(ASSIGNMENT_FIELDS, ASSIGNMENT, 30),
    "q12_sso_admin_policies_table": newest(
        f"user_name, nullif(regexp_extract({POLICY}, '[^/]+$', 0), '') AS policy, "
        f"'ps-' || {tail16(scalar('permissionSetArn'))} AS permission_set, event_time",
        ATTACHED, 30,
    ),
    "q12_sso_admin_policies_full": newest(
        f"event_time, user_name, event_name, {POLICY} AS policy_arn, {tail16(scalar('permissionSetArn'))} AS "
        f"permission_set_id, CASE WHEN contains({POLICY}, 'AdministratorAccess') OR contains({POLICY}, "
        f"'PowerUserAccess') OR contains({POLICY}, 'IAMFullAccess') THEN 'CRITICAL' ELSE 'NORMAL' END AS risk_level, "
        "aws_region, error_code",
        ATTACHED, 30,
    ),
    "q13_sso_applications": newest(
        "event_time, user_name, event_name, "
        f"coalesce(nullif({scalar('displayName')}, 'HIDDEN_DUE_TO_SECURITY_REASONS'), "
        f"CASE WHEN {scalar('displayName')} IS NOT NULL THEN 'Unknown Application' END) AS application_name, "
        f"{scalar('templateId')} AS template_id, {scalar('startUrl')} AS start_url, {scalar('clientId')} AS client_id, "
        "aws_region, error_code",
        f"event_type = 'sso' AND event_name IN ({SSO_APPS})", 30,
    ),
    "q13_sso_applications_sql": newest(
        "event_time, user_name, event_name, CASE event_name "
        f"WHEN 'CreateManagedApplicationInstance' THEN {scalar('applicationName')} "
        f"WHEN 'DeleteManagedApplicationInstance' THEN {scalar('managedApplicationInstanceId')} "
        f"ELSE coalesce({scalar('applicationArn')}, {scalar('applicationId')}) END AS application_identifier, "
        f"{scalar('status')} AS status, aws_region, error_code",
        f"event_type = 'sso' AND event_name IN ({SSO_APPS}, 'UpdateManagedApplicationInstanceStatus')", 90,
    ),
    "q14_sso_admin_users_table": admin_users(""),
    "q14_sso_admin_users_full": admin_users("min(event_time) AS first_admin_action,"),
    "q15_sso_activity_summary": sso_summary(f"WHEN event_name IN ({SSO_APPS}) THEN 'APPLICATION_MGMT'", 20),
    "q15_sso_activity_summary_sql": sso_summary("", 100),
    "q16_table_statistics": f"""{EV} SELECT count(*) AS total_events, count(DISTINCT user_name) AS unique_users,
        count(DISTINCT event_name) AS unique_actions, min(event_time) AS earliest_event,
        max(event_time) AS latest_event, count(*) FILTER (bad) AS error_events,
        count(DISTINCT event_date) AS days_with_data FROM ev""",
    "q17_adhoc_failed_auth": failures("error_code", f"bad AND {SIGN_IN}", ""),
    "q18_adhoc_permission_changes_by_user": f"""{EV} SELECT user_name, event_name, count(*) AS change_count,
        min(day) AS first_change, max(day) AS last_change FROM ev
        WHERE day >= {START[30]} AND event_name IN ({names.IAM_CHANGES_BY_USER})
        GROUP BY user_name, event_name ORDER BY change_count DESC, user_name, event_name""",
    "q19_adhoc_role_assumptions": f"""{EV} SELECT arn AS role_arn, user_name, count(*) AS assumption_count,
        count(*) FILTER (bad) AS failed_count FROM ev
        WHERE day >= {START[30]} AND event_name = 'AssumeRole' AND arn IS NOT NULL
        GROUP BY arn, user_name ORDER BY assumption_count DESC, role_arn, user_name LIMIT 20""",
}

#: Missing keys come last.
GONE = ", ".join(f"CASE WHEN CAST(event_id AS BIGINT) % {n} <> 0 THEN {name} END AS {name}" for name, n in (("user_name", 3), ("source_ip", 5)))
QUERY_ORACLES["q02_null_sort_keys"] = QUERY_ORACLES["q02_failed_auth"].replace(" FROM ev WHERE", f" FROM (SELECT * REPLACE ({GONE}) FROM ev) WHERE")
