"""Raw audit records derived from the supplied ``events``.

Every record is JSON text around an event of the shared recipe.  ``shape``
varies identity, time format and parameters over the cases the normaliser
distinguishes, among them broken text.  One SQL text for Spark and DuckDB.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from verification.recipe import EVENTS_SQL, events_from

RAW_SQL = rf"""
WITH iam_events AS ({EVENTS_SQL}),
shaped AS (
  SELECT *, (CAST(event_id AS BIGINT) + CAST(substr(event_time, 18, 2) AS INTEGER)) % 24 AS shape,
    substr(event_time, 1, 19) AS t
  FROM iam_events),
parts AS (
  SELECT event_id, event_time, shape,
    CASE shape WHEN 0 THEN '"userIdentity":{{"type":"Root"}},'
      WHEN 2 THEN '"userIdentity":{{"type":"AssumedRole","sessionContext":{{"sessionIssuer":{{"arn":"arn:aws:iam::1:role/aws-service-role/s","userName":"svc"}}}}}},'
      WHEN 3 THEN '"userIdentity":{{"type":"AssumedRole","arn":"arn:aws:sts::1:assumed-role/r/bob","sessionContext":{{}}}},'
      WHEN 4 THEN '"userIdentity":{{"type":"AssumedRole","sessionContext":{{"sessionIssuer":{{"arn":"arn:aws:iam::1:role/ok","userName":"issuer4"}}}}}},'
      WHEN 5 THEN '"userIdentity":{{"arn":"arn:aws:iam::1:user/team/alice5"}},'
      WHEN 6 THEN '"userIdentity":{{"arn":"plain"}},'
      WHEN 7 THEN '"userIdentity":{{"principalId":"AIDA7"}},'
      WHEN 8 THEN '"userIdentity":{{}},'
      WHEN 9 THEN ''
      WHEN 10 THEN '"userIdentity":null,'
      WHEN 11 THEN '"userIdentity":{{"type":"AWSService","invokedBy":"x"}},'
      WHEN 13 THEN '"userIdentity":{{"type":"IAMUser","userName":null}},'
      ELSE '"userIdentity":{{"type":"IAMUser","userName":"' || user_name || '"}},' END AS who,
    CASE shape WHEN 15 THEN '' WHEN 16 THEN '"eventTime":"' || t || '.25Z",'
      WHEN 17 THEN '"eventTime":"' || replace(t, 'T', ' ') || '",'
      WHEN 18 THEN '"eventTime":"later",' ELSE '"eventTime":"' || t || 'Z",' END AS stamp,
    CASE shape WHEN 11 THEN '"requestParameters":{{"roleArn":"arn:aws:iam::1:role/aws-service-role/y"}},'
      WHEN 12 THEN '"requestParameters":{{"roleArn":"arn:aws:iam::1/role/team/R12"}},' WHEN 19 THEN ''
      ELSE '"requestParameters":' || request_parameters || ',"responseElements":' || response_elements || ',' END AS body,
    CASE WHEN shape IN (11, 12) THEN 'AssumeRole' ELSE event_name END AS name,
    event_source, aws_region, source_ip, user_agent,
    CASE WHEN error_code IS NULL THEN '' ELSE '"errorCode":"' || error_code || '",' END ||
    CASE WHEN error_message IS NULL THEN '' ELSE '"errorMessage":"' || error_message || '",' END AS err
  FROM shaped)
SELECT event_id, event_time, shape,
  CASE shape WHEN 14 THEN 'not json' ELSE
    '{{' || who || stamp || body || err || '"eventID":"' || event_id || '","eventName":"' || name ||
    '","eventSource":"' || event_source || '","awsRegion":"' || aws_region || '","sourceIPAddress":"' || source_ip ||
    '","userAgent":"' || user_agent || '"}}' END AS raw
FROM parts
"""


def raw_from(spark: SparkSession, sf_dir: str) -> DataFrame:
    events_from(spark, sf_dir)
    return spark.sql(RAW_SQL)
