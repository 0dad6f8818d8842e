"""The shared test recipe: identity events derived from the supplied ``events``.

One SQL text for Spark and DuckDB (see FIXTURES.md, section 2).
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession

#: The day after the last day of the supplied data.
AS_OF = dt.date(2024, 1, 31)
OWN_ACCOUNT = "111111111111"

EVENTS_SQL = r"""
WITH base AS (
  SELECT event_id, ts, user_id, event_type, event_id % 32 AS a, user_id % 7 AS g,
         replace(substr(CAST(ts AS STRING), 1, 19), ' ', 'T') || '+00:00' AS event_time
  FROM events),
named AS (
  SELECT *,
    CASE WHEN a < 8 THEN 'AssumeRole' WHEN a < 11 THEN 'ConsoleLogin' WHEN a = 11 THEN 'GetSessionToken'
         WHEN a = 12 THEN 'CreateUser' WHEN a = 13 THEN 'DeleteUser' WHEN a = 14 THEN 'AttachUserPolicy'
         WHEN a = 15 THEN 'AttachRolePolicy' WHEN a = 16 THEN 'PutUserPolicy' WHEN a = 17 THEN 'CreateAccessKey'
         WHEN a = 18 THEN 'UpdateAccessKey' WHEN a = 19 THEN 'CreateRole' WHEN a = 20 THEN 'UpdateAssumeRolePolicy'
         WHEN a = 21 THEN 'DeleteVirtualMFADevice' WHEN a = 22 THEN 'DeactivateMFADevice' WHEN a = 23 THEN 'ListUsers'
         WHEN a = 24 THEN 'CreatePermissionSet' WHEN a = 25 THEN 'UpdatePermissionSet'
         WHEN a = 26 THEN 'AttachManagedPolicyToPermissionSet' WHEN a = 27 THEN 'CreateAccountAssignment'
         WHEN a = 28 THEN 'DeleteAccountAssignment' WHEN a = 29 THEN 'CreateManagedApplicationInstance'
         WHEN a = 30 THEN 'DeleteManagedApplicationInstance'
         WHEN g < 2 THEN 'UpdateManagedApplicationInstanceStatus' ELSE 'Federate' END AS event_name,
    CASE WHEN a < 8 OR a = 11 THEN 'sts' WHEN a < 11 THEN 'signin' WHEN a < 24 THEN 'iam' ELSE 'sso' END AS event_type_x,
    'arn:aws:sso:::permissionSet/ssoins-0000000000000001/ps-' || lpad(CAST(user_id AS STRING), 16, '0') AS ps_arn,
    CASE g WHEN 0 THEN 'arn:aws:iam::aws:policy/AdministratorAccess' WHEN 1 THEN 'arn:aws:iam::aws:policy/IAMFullAccess'
           WHEN 2 THEN 'arn:aws:iam::aws:policy/PowerUserAccess' ELSE 'arn:aws:iam::aws:policy/ReadOnlyAccess' END AS pol_arn,
    CASE g WHEN 0 THEN '{"Statement":[{"Effect":"Allow","Action":"*","Resource":"*"}]}'
           WHEN 1 THEN '{"Statement":[{"Effect":"Deny","Action":"*"},{"Effect":"Allow","Action":["s3:Get*","iam:*"]}]}'
           WHEN 2 THEN '{"Statement":[{"Effect":"Allow","Action":["sts:*"]}]}'
           ELSE '{"Statement":[{"Effect":"Allow","Action":["s3:GetObject"]}]}' END AS inline_doc,
    CASE g WHEN 0 THEN '{"Statement":[{"Effect":"Allow","Principal":"*"}]}'
           WHEN 1 THEN '{"Statement":[{"Effect":"Allow","Principal":{"AWS":"*"}}]}'
           WHEN 2 THEN '{"Statement":[{"Effect":"Allow","Principal":{"AWS":["arn:aws:iam::999999999999:root"]}}]}'
           WHEN 3 THEN '{"Statement":[{"Effect":"Allow","Principal":{"AWS":"arn:aws:iam::111111111111:root"}}]}'
           ELSE '{"Statement":[{"Effect":"Allow","Principal":{"Service":"ec2.amazonaws.com"}}]}' END AS trust_doc
  FROM base)
SELECT CAST(event_id AS STRING) AS event_id, substr(event_time, 1, 10) AS event_date, event_time, event_name,
  CASE event_type_x WHEN 'sso' THEN 'sso.amazonaws.com' WHEN 'sts' THEN 'sts.amazonaws.com'
                    WHEN 'signin' THEN 'signin.amazonaws.com' ELSE 'iam.amazonaws.com' END AS event_source,
  event_type_x AS event_type,
  CASE user_id % 3 WHEN 0 THEN 'us-east-1' WHEN 1 THEN 'eu-west-1' ELSE 'ap-south-1' END AS aws_region,
  CASE WHEN user_id = 0 THEN 'root' WHEN user_id % 11 = 1 THEN 'unknown'
       WHEN user_id % 5 = 2 THEN 'AROA' || CAST(g AS STRING) || ':session-' || CAST(user_id AS STRING)
       WHEN user_id % 13 = 3 THEN 'a-very-long-federated-user-name-' || CAST(user_id AS STRING)
       ELSE 'user' || CAST(user_id AS STRING) END AS user_name,
  CASE WHEN user_id % 17 = 4 THEN 'cloudformation.amazonaws.com' ELSE '10.0.' || CAST(g AS STRING) || '.' || CAST(user_id AS STRING) END AS source_ip,
  CASE WHEN user_id % 17 = 4 THEN 'cloudformation.amazonaws.com' ELSE 'aws-cli/2' END AS user_agent,
  CASE event_name
    WHEN 'AssumeRole' THEN '{"roleArn":"arn:aws:iam::111111111111:role/Role' || CAST(g AS STRING) || '","roleSessionName":"sess-' || CAST(user_id AS STRING) || '"}'
    WHEN 'ConsoleLogin' THEN 'null' WHEN 'GetSessionToken' THEN '{}' WHEN 'ListUsers' THEN '{}' WHEN 'Federate' THEN 'null'
    WHEN 'AttachUserPolicy' THEN '{"userName":"t' || CAST(g AS STRING) || '","policyArn":"' || pol_arn || '"}'
    WHEN 'AttachRolePolicy' THEN '{"roleName":"r' || CAST(g AS STRING) || '","policyArn":"' || pol_arn || '"}'
    WHEN 'PutUserPolicy' THEN '{"userName":"t' || CAST(g AS STRING) || '","policyName":"p","policyDocument":"' || replace(inline_doc, '"', chr(92) || '"') || '"}'
    WHEN 'UpdateAccessKey' THEN '{"userName":"t' || CAST(g AS STRING) || '","status":"Inactive","accessKeyId":"AKIA0000' || lpad(CAST(user_id AS STRING), 4, '0') || '"}'
    WHEN 'CreateRole' THEN '{"roleName":"r' || CAST(g AS STRING) || '","assumeRolePolicyDocument":"' || replace(trust_doc, '"', chr(92) || '"') || '"}'
    WHEN 'UpdateAssumeRolePolicy' THEN '{"roleName":"r' || CAST(g AS STRING) || '","policyDocument":"' || replace(trust_doc, '"', chr(92) || '"') || '"}'
    WHEN 'DeleteVirtualMFADevice' THEN '{"serialNumber":"mfa-' || CAST(user_id AS STRING) || '"}'
    WHEN 'DeactivateMFADevice' THEN '{"userName":"t' || CAST(g AS STRING) || '","serialNumber":"mfa-' || CAST(user_id AS STRING) || '"}'
    WHEN 'CreatePermissionSet' THEN '{"name":"ps' || CAST(g AS STRING) || '","instanceArn":"arn:aws:sso:::instance/ssoins-0000000000000001","sessionDuration":"PT8H","description":"d' || CAST(g AS STRING) || '"}'
    WHEN 'UpdatePermissionSet' THEN '{"permissionSetArn":"' || ps_arn || '","description":"upd","sessionDuration":"PT4H"}'
    WHEN 'AttachManagedPolicyToPermissionSet' THEN '{"permissionSetArn":"' || ps_arn || '","managedPolicyArn":"' || pol_arn || '"}'
    WHEN 'CreateAccountAssignment' THEN '{"targetId":"1111-1111-000' || CAST(g AS STRING) || '","targetType":"AWS_ACCOUNT","principalId":"pr-' || CAST(user_id AS STRING) || '","principalType":"USER","permissionSetArn":"' || ps_arn || '"}'
    WHEN 'DeleteAccountAssignment' THEN '{"targetId":"11111111000' || CAST(g AS STRING) || '","targetType":"AWS_ACCOUNT","principalId":"pr-' || CAST(user_id AS STRING) || '","principalType":"GROUP","permissionSetArn":"' || ps_arn || '"}'
    WHEN 'CreateManagedApplicationInstance' THEN '{"displayName":"' || CASE WHEN g = 0 THEN 'HIDDEN_DUE_TO_SECURITY_REASONS' ELSE 'App' || CAST(g AS STRING) END || '","templateId":"tpl","startUrl":"https://x","status":"ENABLED"}'
    WHEN 'DeleteManagedApplicationInstance' THEN '{"clientId":"cl-' || CAST(user_id AS STRING) || '","managedApplicationInstanceId":"mai-' || CAST(g AS STRING) || '"}'
    WHEN 'UpdateManagedApplicationInstanceStatus' THEN CASE WHEN g = 0 THEN '{"applicationArn":"app-arn","status":"DISABLED"}' ELSE '{"applicationId":"app-id","status":"ENABLED"}' END
    ELSE '{"userName":"t' || CAST(g AS STRING) || '"}' END AS request_parameters,
  CASE WHEN event_name = 'AssumeRole' AND event_type <> 'error' THEN '{"assumedRoleUser":{"arn":"x"},"credentials":{"expiration":"' || event_date_x || '"}}' ELSE 'null' END AS response_elements,
  CASE WHEN event_type = 'error' AND event_name = 'ConsoleLogin' THEN NULL WHEN event_type = 'error' THEN 'AccessDenied' WHEN a % 2 = 0 THEN '' ELSE NULL END AS error_code,
  CASE WHEN event_type = 'error' AND event_name = 'ConsoleLogin' THEN 'Failed authentication' WHEN event_type = 'error' THEN 'denied' ELSE '' END AS error_message
FROM (SELECT *, substr(event_time, 1, 10) AS event_date_x FROM named) t
"""


def events_from(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The central event table over the whole supplied ``events`` table."""
    spark.read.parquet(f"{sf_dir}/events.parquet").createOrReplaceTempView("events")
    return spark.sql(EVENTS_SQL)
