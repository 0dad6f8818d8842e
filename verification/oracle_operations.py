"""DuckDB statements for the registered operations."""

from __future__ import annotations

from verification.names import ADMIN_POLICIES
from verification.oracle_queries import EV, QUERY_ORACLES, START, scalar
from verification.raw_recipe import RAW_SQL

EVENT_COLUMNS = (
    "event_id, event_date, event_time, event_name, event_source, event_type, aws_region, user_name, source_ip, "
    "user_agent, request_parameters, response_elements, error_code, error_message"
)

# Sources and filters

ROUTED = (
    "((event_source IN ('iam.amazonaws.com', 'signin.amazonaws.com') AND aws_region = 'us-east-1') OR "
    "(event_source IN ('sts.amazonaws.com', 'sso.amazonaws.com') AND aws_region IN ('us-east-1', 'eu-west-1')))"
)
KEY = (
    "CASE event_source WHEN 'iam.amazonaws.com' THEN 'iam-events' WHEN 'signin.amazonaws.com' THEN 'signin-events' "
    "WHEN 'sts.amazonaws.com' THEN 'sts-' || aws_region WHEN 'sso.amazonaws.com' THEN 'sso-' || aws_region END"
)


def role_match(text: str) -> str:
    names = f"regexp_matches({text}, '(^|/)(Role1|.*session-1.*|issuer.*)(/|$)', 'i')"
    return f"coalesce({names} OR lower({text}) = 'arn:aws:iam::111111111111:role/role4', false)"


def key(path: str) -> str:
    return f"json_extract_string(doc, '$.{path}')"


def has(path: str) -> str:
    return f"json_exists(doc, '$.{path}')"


IDENTITY, ISSUER = "userIdentity", "userIdentity.sessionContext.sessionIssuer"
RAW = f"""
WITH raw AS ({RAW_SQL}),
docs AS (SELECT *, CASE WHEN json_valid(raw) THEN raw END AS doc FROM raw),
read AS (
  SELECT event_id AS source_id, event_time AS source_time,
    coalesce(json_type(doc, '$.eventTime') = 'VARCHAR' AND coalesce(json_type(doc, '$.{IDENTITY}'), 'OBJECT') = 'OBJECT',
      false) AS ok,
    {key('eventID')} AS event_id, {key('eventTime')} AS t, {key('eventName')} AS event_name,
    {key('eventSource')} AS event_source, {key('awsRegion')} AS aws_region, {key('sourceIPAddress')} AS source_ip,
    {key('userAgent')} AS user_agent, {key('errorCode')} AS error_code, {key('errorMessage')} AS error_message,
    {key('requestParameters.roleArn')} AS role_arn,
    CASE json_type(doc, '$.requestParameters') WHEN 'NULL' THEN 'null' WHEN 'OBJECT' THEN
      CASE WHEN len(json_keys(doc, '$.requestParameters')) = 0 THEN '{{}}' ELSE {key('requestParameters.roleArn')} END
      ELSE '{{}}' END AS request_kind,
    coalesce(CAST(json_extract(doc, '$.requestParameters') AS VARCHAR), '{{}}') AS request_parameters,
    {key(IDENTITY + '.type')} AS kind, {key(ISSUER + '.arn')} AS issuer_arn,
    CASE
      WHEN {key('eventName')} = 'AssumeRole' AND contains({key('requestParameters.roleArn')}, '/role/')
        THEN regexp_extract({key('requestParameters.roleArn')}, '^.*/role/(.*)$', 1)
      WHEN {key('eventName')} = 'ConsoleLogin' AND {key(IDENTITY + '.type')} = 'Root' THEN 'root'
      WHEN {has(IDENTITY + '.userName')} THEN {key(IDENTITY + '.userName')}
      WHEN {has(IDENTITY + '.sessionContext')}
        THEN CASE WHEN {has(ISSUER + '.userName')} THEN {key(ISSUER + '.userName')} ELSE 'unknown' END
      WHEN {has(IDENTITY + '.arn')} THEN
        coalesce(nullif(regexp_extract({key(IDENTITY + '.arn')}, '/([^/]*)$', 1), ''), 'unknown')
      WHEN {has(IDENTITY + '.principalId')} THEN {key(IDENTITY + '.principalId')}
      ELSE 'unknown' END AS user_name
  FROM docs),
parsed AS (
  SELECT *,
    CASE WHEN t = 'later' THEN '2024-01-31T00:00:00' ELSE replace(left(t, 19), ' ', 'T') ||
      CASE WHEN contains(t, '.') THEN '.' || rpad(regexp_extract(t, '\\.(\\d+)Z', 1), 6, '0') ELSE '' END
    END || '+00:00' AS event_time,
    CASE event_source WHEN 'iam.amazonaws.com' THEN 'iam' WHEN 'sts.amazonaws.com' THEN 'sts'
      WHEN 'signin.amazonaws.com' THEN 'signin' WHEN 'sso.amazonaws.com' THEN 'sso' ELSE 'other' END AS event_type,
    CASE WHEN NOT ok THEN 'unparsable'
      WHEN coalesce(contains(issuer_arn, '/aws-service-role/'), false) OR (coalesce(kind, '') = 'AWSService'
        AND (suffix(user_agent, '.amazonaws.com') OR suffix(source_ip, '.amazonaws.com'))
        AND coalesce(contains(role_arn, '/aws-service-role/'), false)) THEN 'service'
      WHEN (event_name = 'AssumeRole' AND {role_match('role_arn')}) OR {role_match('user_name')} THEN 'role'
      ELSE 'kept' END AS outcome
  FROM read)
"""
RAW_VIEW = (
    "event_id, left(event_time, 10) AS event_date, event_time, event_name, event_source, event_type, aws_region, "
    "user_name, source_ip, user_agent, error_code, error_message, request_kind"
)

# Alerts

def admin_policy(arn: str) -> str:
    return "CASE " + " ".join(f"WHEN contains({arn}, '{name}') THEN '{name}'" for name in ADMIN_POLICIES) + " END"


def param(name: str, default: str = "unknown") -> str:
    return f"coalesce(json_extract_string(request_parameters, '$.{name}'), '{default}')"


SET_ID = f"regexp_extract({param('permissionSetArn')}, '([^/]*)$', 1)"

# Inline and trust documents: one row per statement, in order.
ALERT_STEPS = f""",
e AS (SELECT * REPLACE (coalesce(user_name, 'None') AS user_name), CASE event_name WHEN 'CreateRole' THEN json_extract_string(request_parameters, '$.assumeRolePolicyDocument')
        WHEN 'UpdateAssumeRolePolicy' THEN json_extract_string(request_parameters, '$.policyDocument')
        WHEN 'PutUserPolicy' THEN json_extract_string(request_parameters, '$.policyDocument') END AS document
      FROM ev WHERE user_name IS DISTINCT FROM 'unknown' AND event_id <> ''),
statements AS (
  SELECT event_id, s.pos AS pos, s.statement AS statement
  FROM (SELECT event_id, json_extract(document, '$.Statement[*]') AS list FROM e WHERE document IS NOT NULL) d,
    LATERAL (SELECT unnest(d.list) AS statement, generate_subscripts(d.list, 1) AS pos) s),
allowed AS (
  SELECT event_id, pos,
    CASE json_type(statement, '$.Action') WHEN 'ARRAY' THEN json_extract_string(statement, '$.Action[*]')
      WHEN 'VARCHAR' THEN [json_extract_string(statement, '$.Action')] ELSE [] END AS actions,
    CASE json_type(statement, '$.Principal.AWS') WHEN 'ARRAY' THEN json_extract_string(statement, '$.Principal.AWS[*]')
      WHEN 'VARCHAR' THEN [json_extract_string(statement, '$.Principal.AWS')] ELSE [] END AS principals,
    coalesce(json_extract_string(statement, '$.Principal') = '*', false)
      OR coalesce(json_extract_string(statement, '$.Principal.AWS') = '*', false) AS open
  FROM statements WHERE json_extract_string(statement, '$.Effect') = 'Allow'),
judged AS (
  SELECT event_id, pos,
    list_filter(actions, lambda x: x IN ('*', 'iam:*', 'sts:*'))[1] AS action,
    CASE WHEN open THEN '*' ELSE
      list_filter(list_transform(list_filter(principals, lambda x: contains(x, ':root')), lambda x: split_part(x, ':', 5)),
        lambda x: x NOT IN ('', '111111111111'))[1] END AS trust
  FROM allowed),
findings AS (
  SELECT event_id, arg_min(action, pos) FILTER (action IS NOT NULL) AS action,
    arg_min(trust, pos) FILTER (trust IS NOT NULL) AS trust
  FROM judged GROUP BY event_id),
found AS (
  SELECT e.*, CASE WHEN event_name = 'PutUserPolicy' THEN action END AS action,
    CASE WHEN event_name IN ('CreateRole', 'UpdateAssumeRolePolicy') THEN trust END AS trust,
    CASE event_name WHEN 'AttachUserPolicy' THEN {admin_policy(param('policyArn', ''))}
      WHEN 'AttachManagedPolicyToPermissionSet' THEN {admin_policy(param('managedPolicyArn', ''))} END AS policy
  FROM e LEFT JOIN findings USING (event_id)),
ruled AS (
  SELECT *, CASE
    WHEN event_name = 'ConsoleLogin' AND user_name = 'root' THEN CASE WHEN coalesce(error_message, '') <> ''
      THEN ['AL-01', 'CRITICAL', 'Failed Root Login', 'Failed root login attempt from IP: ' || source_ip]
      ELSE ['AL-01', 'CRITICAL', 'Root Account Login', 'Root account logged in from IP: ' || source_ip] END
    WHEN event_name <> 'CreateAccessKey' AND request_parameters IN ('{{}}', 'null') THEN NULL
    WHEN event_name = 'CreateUser' THEN ['AL-02', 'HIGH', 'IAM User Created',
      'New IAM user ''' || {param('userName')} || ''' created by ' || user_name]
    WHEN event_name = 'AttachUserPolicy' AND policy IS NOT NULL THEN ['AL-03', 'CRITICAL', 'Admin Policy Attached',
      'Admin policy ' || policy || ' attached to user ''' || {param('userName')} || ''' by ' || user_name]
    WHEN action IS NOT NULL THEN ['AL-04', 'CRITICAL', CASE action WHEN '*' THEN 'Full Admin Policy Attached'
        WHEN 'iam:*' THEN 'Full IAM Permissions Attached' ELSE 'Full STS Permissions Attached' END,
      'Policy ''' || {param('policyName')} || ''' with ' || CASE action WHEN '*' THEN 'full admin (*:*)'
        WHEN 'iam:*' THEN 'full IAM' ELSE 'full STS' END || ' permissions attached to user ''' ||
        {param('userName')} || ''' by ' || user_name]
    WHEN event_name = 'CreateAccessKey' THEN ['AL-05', 'CRITICAL', 'Access Key Created',
      'New access key created for user ''' || coalesce(json_extract_string(request_parameters, '$.userName'), user_name)
        || ''' by ' || user_name]
    WHEN trust = '*' THEN ['AL-06', 'CRITICAL', 'Role Trust Policy with Wildcard Principal', 'Role ''' ||
      {param('roleName')} || ''' created/updated with trust policy allowing ANY principal by ' || user_name]
    WHEN trust IS NOT NULL THEN ['AL-06', 'CRITICAL', 'Role Trust Policy with External Account', 'Role ''' ||
      {param('roleName')} || ''' allows access from external account ' || trust || ' - modified by ' || user_name]
    WHEN event_name = 'UpdateAccessKey' THEN ['AL-07', 'HIGH', 'Access Key Updated', 'Access key ' ||
      right({param('accessKeyId')}, 4) || ' for user ''' || {param('userName')} || ''' changed to ' ||
      {param('status')} || ' by ' || user_name]
    WHEN event_name = 'DeleteVirtualMFADevice' THEN ['AL-08', 'CRITICAL', 'MFA Device Deleted',
      'Virtual MFA device ' || {param('serialNumber')} || ' deleted by ' || user_name]
    WHEN event_name = 'DeactivateMFADevice' THEN ['AL-08', 'CRITICAL', 'MFA Device Deactivated', 'MFA device ' ||
      {param('serialNumber')} || ' deactivated for user ''' || {param('userName')} || ''' by ' || user_name]
    WHEN event_name = 'CreatePermissionSet' THEN ['AL-09', 'CRITICAL', 'SSO Permission Set Created',
      'New SSO permission set ''' || {param('name')} || ''' created by ' || user_name || ' in instance ' ||
      right({param('instanceArn')}, 10) || ' with session duration ' || {param('sessionDuration')}]
    WHEN event_name = 'UpdatePermissionSet' THEN ['AL-10', 'CRITICAL', 'SSO Permission Set Updated',
      'SSO permission set ' || {SET_ID} || ' updated by ' || user_name || ' - Description: ''' ||
      {param('description', '')} || ''', Session Duration: ' || {param('sessionDuration', '')}]
    WHEN event_name = 'AttachManagedPolicyToPermissionSet' AND policy IS NOT NULL THEN ['AL-11', 'CRITICAL',
      'Admin Policy Attached to SSO Permission Set', 'Admin policy ' || policy ||
      ' attached to SSO permission set ' || {SET_ID} || ' by ' || user_name]
    WHEN event_name = 'CreateAccountAssignment' THEN ['AL-12', 'CRITICAL', 'SSO Account Assignment Created',
      'SSO account assignment created by ' || user_name || ' - ' || {param('principalType')} || ' ' ||
      {param('principalId')} || ' granted permission set ' || {SET_ID} || ' on ' || {param('targetType')} || ' ' ||
      {param('targetId')}]
    WHEN event_name = 'CreateManagedApplicationInstance' THEN ['AL-13', 'HIGH', 'SSO Application Instance Created',
      'New SSO application instance ''' || replace({param('displayName')}, 'HIDDEN_DUE_TO_SECURITY_REASONS', 'unknown')
      || ''' created by ' || user_name || ' - Template: ' || {param('templateId')} || ', URL: ' || {param('startUrl')}]
    WHEN event_name = 'DeleteManagedApplicationInstance' THEN ['AL-14', 'HIGH', 'SSO Application Instance Deleted',
      'SSO application instance (client ID: ' || {param('clientId')} || ') deleted by ' || user_name]
    END AS rule
  FROM found),
alerts AS (
  SELECT event_id, event_date, event_time, event_name, user_name, source_ip, aws_region,
    rule[1] AS rule_id, rule[2] AS alert_type, rule[3] AS alert_title, rule[4] AS alert_message
  FROM ruled WHERE rule IS NOT NULL)
"""

ALERTS = EV + ALERT_STEPS
# Loading takes no time that depends on the run: such a record is unparsable.
LOADED = RAW.replace("WHEN NOT ok THEN", "WHEN NOT ok OR t = 'later' THEN")
LOADED_ALERTS = LOADED + ", ev AS (SELECT *, left(event_time, 10) AS event_date FROM parsed WHERE outcome = 'kept')" + ALERT_STEPS

# 30 days after 1 and 20 January 2024, in epoch seconds.
TTL_OLD, TTL_RECENT = 1704067200 + 30 * 86400, 1705708800 + 30 * 86400

# Lake


def lifted(column: str, path: str) -> str:
    return (
        f"CASE WHEN json_exists({column}, '$.{path}') THEN json_extract_string({column}, '$.{path}') ELSE '' END"
    )


LAKE_ROW = f"""{EV} SELECT {EVENT_COLUMNS}, {lifted('request_parameters', 'roleArn')} AS role_arn,
  {lifted('request_parameters', 'roleSessionName')} AS role_session_name,
  {lifted('request_parameters', 'policyArn')} AS policy_arn, {lifted('request_parameters', 'userName')} AS user_name_param,
  {lifted('request_parameters', 'groupName')} AS group_name,
  coalesce(CAST(json_extract(response_elements, '$.assumedRoleUser') AS VARCHAR), '{{}}') AS assumed_role_user,
  {lifted('response_elements', 'credentials.expiration')} AS credentials_expiration, who AS user_identity,
  bad AS is_error, CAST(day[1:4] AS INTEGER) AS year, CAST(day[6:7] AS INTEGER) AS month,
  CAST(day[9:10] AS INTEGER) AS day, coalesce(aws_region, 'unknown') AS region FROM ev"""

# Loading

LOADS = f"""{EV},
stored AS (SELECT *, 0 AS load FROM ev WHERE day < '2024-01-21'),
loads AS (
  SELECT * REPLACE ('first load' AS error_message), 1 AS load FROM ev WHERE day >= '2024-01-15' UNION ALL
  SELECT * REPLACE ('second load' AS error_message), 2 AS load FROM ev WHERE event_time >= '2024-01-18T12')
"""
STORED = "event_date, event_id, event_name, error_message"
UPSERTED = f"""{LOADS} SELECT event_date, event_id, max(event_name) AS event_name, arg_max(error_message, load)
  AS error_message FROM (SELECT * FROM stored UNION ALL SELECT * FROM loads) GROUP BY event_date, event_id"""

TIME = "CAST(left(event_time, 19) AS TIMESTAMP)"


def control(moment: str, condition: str) -> str:
    return f"""SELECT {KEY} AS checkpoint_key, max({TIME}) AS last_processed_timestamp,
      TIMESTAMP '{moment}' AS last_execution_time, count(*) AS events_processed_count
      FROM ev WHERE {condition} GROUP BY 1"""


# Reports

SIZES = f"""{EV}, sizes AS (
  SELECT event_date, aws_region, sum(length(request_parameters) + length(response_elements)) AS size,
    CASE WHEN DATE '2024-04-15' - CAST(event_date AS DATE) >= 90 THEN 'GLACIER' ELSE 'STANDARD_IA' END AS storage_class
  FROM ev GROUP BY event_date, aws_region),
by_class AS (
  SELECT storage_class, CAST(sum(size) AS BIGINT) AS size_bytes, count(*) AS object_count,
    sum(size) / 1073741824.0::DOUBLE AS size_gb,
    sum(size) / 1073741824.0::DOUBLE * CASE storage_class WHEN 'GLACIER' THEN 0.004::DOUBLE ELSE 0.0125::DOUBLE END
      AS monthly_cost_usd
  FROM sizes GROUP BY storage_class)
"""


def tier(as_of: str) -> str:
    age = f"(DATE '{as_of}' - CAST(event_date AS DATE))"
    return (
        f"CASE WHEN {age} < 30 THEN 'STANDARD' WHEN {age} < 90 THEN 'STANDARD_IA' WHEN {age} < 365 THEN 'GLACIER' "
        "ELSE 'DEEP_ARCHIVE' END"
    )


def windows(width: str) -> str:
    return (
        f"{EV} SELECT date_trunc('{width}', {TIME}) AS window_start, count(*) AS total_events, "
        "count(*) FILTER (bad) AS failed_events, count(DISTINCT user_name) AS approx_users, "
        "count(DISTINCT event_name) AS approx_actions FROM ev GROUP BY 1"
    )


def since(days: int) -> str:
    return (
        f"{EV} SELECT {days} AS days, count(*) AS total_events, count(*) FILTER (bad) AS failed_events, "
        "count(DISTINCT user_name) AS unique_users, count(DISTINCT event_name) AS unique_actions, "
        f"count(DISTINCT day) AS active_days FROM ev WHERE day >= {START[days]}"
    )


#: Exact counts; sketches hold so few users exactly.
SINCE = " UNION ALL ".join(f"SELECT * FROM ({since(days)})" for days in (7, 30, 90))

#: Arrival of the two sources' files, and the watermark at which a batch drops
#: rows: the least of the sources' newest times two batches ago, less five minutes.
ARRIVED = f"""{EV}, delivered AS (
  SELECT event_date, event_id, {TIME} AS t, CASE WHEN event_type = 'sso' THEN 'slow' ELSE 'fast' END AS source_name,
    (CAST(event_date[9:10] AS INTEGER) - 1) // 3 + CASE WHEN event_type = 'sso' AND event_date[9:10] > '01' THEN 1 ELSE 0 END
      + CASE WHEN CAST(event_id AS BIGINT) % 40 = 7 THEN 2 ELSE 0 END AS file FROM ev),
arrived AS (SELECT * FROM delivered WHERE file < 13),
newest AS (SELECT b.batch, source_name, max(t) AS t FROM range(13) b(batch) JOIN arrived ON file <= b.batch GROUP BY ALL),
marks AS (SELECT batch, min(t) - INTERVAL 5 MINUTE AS mark FROM newest GROUP BY batch HAVING count(*) = 2),
judged AS (SELECT arrived.*, coalesce(t <= mark, false) AS late FROM arrived LEFT JOIN marks ON marks.batch = file - 2)
"""


DAILY = QUERY_ORACLES["q08_daily_summary"]
PER_DATE = "event_date, count(*) AS events FROM ev GROUP BY event_date"

OPERATION_ORACLES: dict[str, str] = {
    "lookup_by_user": f"""{EV} SELECT {EVENT_COLUMNS} FROM ev WHERE user_name = 'user5' AND day >= '2024-01-10'
        AND day <= '2024-01-20' ORDER BY event_date, event_id LIMIT 100""",
    "lookup_by_action": f"""{EV} SELECT {EVENT_COLUMNS} FROM ev WHERE event_name = 'CreateUser'
        ORDER BY event_date, event_id LIMIT 100""",
    "scan_date_range": f"{EV} SELECT {EVENT_COLUMNS} FROM ev WHERE day BETWEEN '2024-01-05' AND '2024-01-20'",
    "source_routing": f"{EV} SELECT event_id, event_source, aws_region FROM ev WHERE {ROUTED}",
    "source_routing_table": f"{EV} SELECT {KEY} AS checkpoint_key, count(*) AS events FROM ev WHERE {ROUTED} GROUP BY 1",
    "role_filter": f"""{EV} SELECT event_id, user_name, event_name FROM ev
        WHERE NOT ((event_name = 'AssumeRole' AND {role_match('arn')}) OR {role_match('user_name')})""",
    "raw_normalized": f"{RAW} SELECT {RAW_VIEW} FROM parsed WHERE outcome <> 'unparsable'",
    "raw_kept_events": f"{RAW} SELECT {RAW_VIEW} FROM parsed WHERE outcome = 'kept'",
    "raw_drop_reasons": f"{RAW} SELECT outcome, count(*) AS records FROM parsed GROUP BY outcome",
    "raw_envelopes": f"""{RAW} SELECT 'env-' || source_id AS event_id, source_time AS event_time,
        'Wrapped' AS event_name, user_name, error_code FROM parsed WHERE ok""",
    "lake_row": LAKE_ROW,
    "lake_export": f"""WITH l AS ({LAKE_ROW}) SELECT year, month, day, region, count(*) AS events,
        count(*) FILTER (is_error) AS errors FROM l GROUP BY ALL""",
    "lake_catch_up": f"{EV} SELECT {PER_DATE}",
    "lake_region_counts": f"""{EV} SELECT event_date, coalesce(aws_region, 'unknown') AS region,
        count(*) AS events FROM ev GROUP BY 1, 2""",
    "lake_daily_summary": DAILY,
    "lake_user_lookup_full": QUERY_ORACLES["q01_user_lookup_full"],
    "missing_dates": f"{EV} SELECT DISTINCT event_date FROM ev WHERE day >= '2024-01-21' ORDER BY event_date",
    "missing_events": f"{EV} SELECT event_date, event_id, event_time FROM ev WHERE event_time >= '2024-01-25T12'",
    "insert_new_events": f"""{LOADS} SELECT event_date, event_id, max(event_name) AS event_name,
        arg_min(error_message, load) AS error_message FROM loads ANTI JOIN stored USING (event_date, event_id)
        GROUP BY event_date, event_id""",
    "upsert_events": UPSERTED,
    "upsert_written": UPSERTED,
    "insert_written": f"""{LOADS} SELECT {STORED} FROM stored UNION ALL SELECT {STORED} FROM loads
        ANTI JOIN stored USING (event_date, event_id) WHERE load = 1""",
    "checkpoint_init": f"""{EV} SELECT DISTINCT {KEY} AS checkpoint_key,
        TIMESTAMP '2023-11-02' AS last_processed_timestamp, TIMESTAMP '2024-01-31' AS last_execution_time,
        CAST(0 AS BIGINT) AS events_processed_count, 'active' AS processing_status, '' AS last_error FROM ev""",
    "checkpoint_advance": f"""{EV}, early AS ({control('2024-01-21', "day < '2024-01-21'")}),
        late AS ({control('2024-01-31', "day >= '2024-01-21'")})
        SELECT checkpoint_key, greatest(e.last_processed_timestamp, l.last_processed_timestamp) AS last_processed_timestamp,
          coalesce(l.last_execution_time, e.last_execution_time) AS last_execution_time,
          coalesce(e.events_processed_count, 0) + coalesce(l.events_processed_count, 0) AS events_processed_count,
          'active' AS processing_status, '' AS last_error FROM early e FULL JOIN late l USING (checkpoint_key)""",
    "incremental_read": f"""{EV}, early AS ({control('2024-01-21', "day < '2024-01-21'")})
        SELECT event_id, event_time, event_source, aws_region FROM ev LEFT JOIN early ON checkpoint_key = {KEY}
        WHERE {TIME} >= coalesce(last_processed_timestamp, TIMESTAMP '2023-11-01 12:00:00')
          AND {TIME} <= TIMESTAMP '2024-01-30 11:55:00'""",
    "collection_run": f"""{LOADED}, fate AS (SELECT CASE WHEN outcome = 'unparsable' THEN outcome
          WHEN NOT coalesce({ROUTED}, false) THEN 'not_routed' WHEN event_time > '2024-01-30T23:55:00+00:00' THEN 'settling'
          ELSE outcome END AS fate FROM parsed)
        SELECT 200 AS status, count(*) FILTER (fate = 'kept') AS total_events_processed,
        count(*) FILTER (fate = 'role') AS filtered_by_role, count(*) FILTER (fate = 'service') AS
        filtered_by_service, count(*) FILTER (fate = 'unparsable') AS unparsable, count(*) FILTER (fate = 'not_routed') AS
        not_routed, CAST(0 AS BIGINT) AS late, count(*) FILTER (fate = 'settling') AS settling,
        count(*) FILTER (fate = 'kept') AS events_added, CAST(0 AS BIGINT) AS events_changed FROM fate""",
    "alerts_all": f"{ALERTS} SELECT * FROM alerts",
    "alerts_deduped": f"""{ALERTS} SELECT event_id, alert_type, rule_id, alert_title FROM alerts
        WHERE event_time < '2024-01-01T00' OR event_time >= '2024-01-16' OR
          (event_time < '2024-01-08' AND {TTL_OLD} <= epoch(TIMESTAMP '2024-01-31'))""",
    "alert_notices": f"""{ALERTS} SELECT event_id, event_name AS event_name_attribute,
        sha256(event_id || '|' || alert_type || '|' || alert_title) AS message_id,
        '[' || alert_type || '] IAM Alert: ' || alert_title AS subject,
        chr(10) || 'IAM Activity Alert: ' || alert_title || chr(10) || chr(10) || 'Severity: ' || alert_type || chr(10)
        || 'Time: ' || event_time || chr(10) || 'Region: ' || aws_region || chr(10) || chr(10) || alert_message
        || chr(10) || chr(10) || 'Event Details:' || chr(10) || '- Event Name: ' || event_name || chr(10)
        || '- User: ' || user_name || chr(10) || '- Source IP: ' || source_ip || chr(10) || '- Event ID: ' || event_id
        || chr(10) || chr(10) || 'Action Required: Review this activity immediately in CloudTrail.' || chr(10) AS body
        FROM alerts""",
    "sent_alerts_active": f"""{ALERTS} SELECT event_id, alert_type, CAST({TTL_RECENT} AS BIGINT) AS ttl FROM alerts
        WHERE event_time >= '2024-01-08' AND event_time < '2024-01-16'""",
    "tier_by_age": f"""{EV} SELECT event_id, {tier('2024-01-31')} AS tier_now, {tier('2024-04-15')} AS tier_spring,
        {tier('2025-01-15')} AS tier_next_year FROM ev""",
    "storage_by_class": f"{SIZES} SELECT * FROM by_class",
    "lake_storage_report": f"""{EV} SELECT DISTINCT event_date, coalesce(aws_region, 'unknown') AS region,
        {tier('2024-04-15')} AS storage_class FROM ev""",
    "storage_total": f"""{SIZES} SELECT CAST(sum(size_bytes) AS BIGINT) AS total_size_bytes,
        CAST(sum(object_count) AS BIGINT) AS object_count, sum(monthly_cost_usd) AS estimated_monthly_cost_usd,
        sum(size_bytes) / 1073741824.0::DOUBLE AS total_size_gb FROM by_class""",
    "scan_cost": f"""{SIZES} SELECT event_date, CAST(sum(size) AS BIGINT) AS bytes_scanned,
        sum(size) / 1099511627776.0::DOUBLE * 5.0::DOUBLE AS scan_cost_usd FROM sizes GROUP BY event_date""",
    "json_export": f"""SELECT CAST(to_json({{'activity_date': activity_date, 'total_events': total_events,
        'unique_users': unique_users, 'unique_actions': unique_actions, 'failed_events': failed_events,
        'users_created': users_created, 'users_deleted': users_deleted, 'policy_changes': policy_changes,
        'role_assumptions': role_assumptions}}) AS VARCHAR) AS document FROM ({DAILY})""",
    "result_display": f"""SELECT coalesce(role_name, '') AS role_name, coalesce(assumed_by, '') AS assumed_by,
        CAST(assumption_count AS VARCHAR) AS assumption_count, CAST(failed_assumptions AS VARCHAR) AS failed_assumptions
        FROM ({QUERY_ORACLES['q07_role_assumptions']})""",
    "stream_daily_counts": windows("day"),
    "stream_hourly_counts": windows("hour"),
    "stream_sketches": SINCE,
    "stream_late_events": f"""{ARRIVED} SELECT strftime(date_trunc('hour', t), '%Y-%m-%d %H:%M') AS window_start, source_name,
        count(*) AS total_events FROM judged WHERE NOT late
          AND date_trunc('hour', t) + INTERVAL 1 HOUR <= (SELECT max(mark) FROM marks) GROUP BY ALL
        UNION ALL SELECT 'total', 'arrived', count(*) FROM judged
        UNION ALL SELECT 'total', 'kept', count(*) FROM judged WHERE NOT late
        UNION ALL SELECT 'total', 'repeated', 0
        UNION ALL SELECT 'total', 'late', count(*) FROM judged WHERE late""",
    "stream_alerts_once": f"{ALERTS} SELECT DISTINCT event_id, alert_type FROM alerts",
    "bucketed_upsert_written": UPSERTED,
    "bucketed_insert_written": f"""{LOADS} SELECT {STORED} FROM stored UNION ALL SELECT {STORED} FROM loads
        ANTI JOIN stored USING (event_date, event_id) WHERE load = 1""",
    "store_compacted": f"{EV} SELECT {PER_DATE.replace('AS events', 'AS events, CAST(1 AS BIGINT) AS files')}",
    "ledger_counts": f"""{EV} SELECT event_date, coalesce(aws_region, 'unknown') AS region, count(*) AS events FROM ev GROUP BY 1, 2""",
    "ledger_catch_up": f"{EV} SELECT event_date, count(*) AS events, count(*) AS counted FROM ev GROUP BY event_date",
    "lake_refreshed": f"""{EV} SELECT event_date, coalesce(aws_region, 'unknown') AS region, count(*) AS events FROM ev GROUP BY 1, 2""",
    "shredded_permission_sets": QUERY_ORACLES["q10_sso_permission_sets_sql"],
    "shredded_account_assignments": QUERY_ORACLES["q11_sso_account_assignments_sql"],
    "shredded_admin_policies": QUERY_ORACLES["q12_sso_admin_policies_full"],
    "shredded_applications": QUERY_ORACLES["q13_sso_applications_sql"],
    "sql_failed_auth": QUERY_ORACLES["q02_failed_auth_sql"],
    "sql_daily_summary": QUERY_ORACLES["q08_daily_summary_sql"],
    "sql_role_assumptions": QUERY_ORACLES["q07_role_assumptions_sql"],
    "sql_account_assignments": QUERY_ORACLES["q11_sso_account_assignments_sql"],
    "lookup_in_user_copy": f"""{EV} SELECT {EVENT_COLUMNS} FROM ev WHERE user_name = 'user5' AND day >= '2024-01-10'
        AND day <= '2024-01-20' ORDER BY event_date, event_id LIMIT 100""",
    "scanned_files": f"""{EV} SELECT DISTINCT event_date, coalesce(aws_region, 'unknown') AS region, true AS all_bytes
        FROM ev WHERE day >= {START[7]}""",
    "sketch_distinct_counts": SINCE,
    "sketch_daily_summary": DAILY,
    "sketch_active_users": f"""{EV} SELECT who AS user_identity, count(*) AS total_actions FROM ev WHERE day >= {START[30]}
        AND user_name <> 'unknown' GROUP BY who ORDER BY total_actions DESC, user_identity LIMIT 30""",
    "stream_deduplicated": f"{EV} SELECT {PER_DATE}",
    "raw_files": f"{RAW} SELECT {RAW_VIEW} FROM parsed WHERE outcome = 'kept'",
    "stream_alerts": f"""{LOADED_ALERTS} SELECT event_id, alert_type, rule_id, alert_title, alert_message FROM alerts""",
    "stream_ingest": f"{LOADED} SELECT {RAW_VIEW} FROM parsed WHERE outcome = 'kept'",
}
