"""Declared schemas; nothing in the engine infers a schema from data."""

from pyspark.sql import types as T


def _strings(names: list[str]) -> list[T.StructField]:
    return [T.StructField(name, T.StringType()) for name in names]


# The column names of the stored and exported tables.
#: The central event table.  Row identity is (event_date, event_id).
EVENTS = T.StructType(_strings([
    "event_id", "event_date", "event_time", "event_name", "event_source", "event_type", "aws_region",
    "user_name", "source_ip", "user_agent", "request_parameters", "response_elements", "error_code",
    "error_message",
]))
EVENT_COLUMNS = EVENTS.fieldNames()
EVENT_KEY = ["event_date", "event_id"]

LIFTED = _strings([
    "role_arn", "role_session_name", "policy_arn", "user_name_param", "group_name", "assumed_role_user",
    "credentials_expiration", "user_identity",
])
LAKE_PARTITIONS = ["year", "month", "day", "region"]
#: The analytics table: events, lifted JSON fields, error flag, partitions.
LAKE = T.StructType(
    EVENTS.fields
    + LIFTED
    + [T.StructField("is_error", T.BooleanType())]
    + [T.StructField(name, T.IntegerType()) for name in LAKE_PARTITIONS[:3]]
    + [T.StructField("region", T.StringType())]
)

#: Requests and responses as parsed values, by the text column they come from;
#: a lake may keep them too, each of their common fields in a column of its own.
VARIANTS = {"request_parameters": "request", "response_elements": "response"}
LAKE_WITH_VARIANTS = T.StructType(
    LAKE.fields[: -len(LAKE_PARTITIONS)]
    + [T.StructField(name, T.VariantType()) for name in VARIANTS.values()]
    + LAKE.fields[-len(LAKE_PARTITIONS) :]
)

#: One row per collected source; times are UTC wall-clock.
CONTROL = T.StructType([
    T.StructField("checkpoint_key", T.StringType()),
    T.StructField("last_processed_timestamp", T.TimestampNTZType()),
    T.StructField("last_execution_time", T.TimestampNTZType()),
    T.StructField("events_processed_count", T.LongType()),
    T.StructField("processing_status", T.StringType()),
    T.StructField("last_error", T.StringType()),
])

SENT_ALERTS = T.StructType(
    _strings(["event_id", "alert_type", "rule_id", "alert_title", "message_id", "sent_date"])
    + [T.StructField("sent_timestamp", T.TimestampNTZType()), T.StructField("ttl", T.LongType())]
)

# The field names of delivered files and envelopes.
#: Raw delivery files hold one top-level array of records, kept as JSON text.
RAW_FILE = T.StructType([T.StructField("Records", T.ArrayType(T.StringType()))])
ENVELOPE = T.StructType([
    T.StructField("EventId", T.StringType()),
    T.StructField("EventTime", T.TimestampType()),
    T.StructField("EventName", T.StringType()),
    T.StructField("CloudTrailEvent", T.StringType()),
])
