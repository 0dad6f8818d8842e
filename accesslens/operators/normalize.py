"""Raw record -> parsed record -> event row.

``parse_records`` keeps every row and names in ``drop_reason`` why a record
cannot be used; the noise filters add their reasons and ``kept`` removes them
all, so one pass yields both the events and the counts.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from accesslens.fixed import EVENT_TYPES, UNKNOWN
from accesslens.functions.json import is_object, is_text, key_present, open_once
from accesslens.functions.text import not_blank
from accesslens.functions.time import instant_to_utc, iso, literal, parse_time
from accesslens.schema import EVENT_COLUMNS

UNPARSABLE = "unparsable"

# Fields read from a record.  VARIANT keeps the difference between a missing
# key (NULL) and a JSON null (a value).
RECORD_FIELDS = {
    "eventID": "string", "eventTime": "variant", "eventName": "string", "eventSource": "string", "awsRegion": "string",
    "sourceIPAddress": "string", "userAgent": "string", "errorCode": "string", "errorMessage": "string",
    "requestParameters": "variant", "responseElements": "variant", "userIdentity": "variant",
}
RECORD = f"struct<{', '.join(f'{name}: {kind}' for name, kind in RECORD_FIELDS.items())}>"


def _text(part: str, path: str = "$") -> Column:
    return F.try_variant_get(part, path, "string")


def _identity(path: str) -> Column:
    return _text("userIdentity", path)


def _has(path: str) -> Column:
    return key_present(F.col("userIdentity"), path)


def _object_if_present(path: str) -> Column:
    return ~_has(path) | is_object(F.col("userIdentity"), path)


def user_name(role_marker: str = "/role/") -> Column:
    """Who acted, by the first rule that applies to a record's fields.

    A key that exists with a null value still decides its rule and gives
    NULL.  ``role_marker`` is taken literally; standard role ARNs contain
    ``:role/``, which the default does not match.
    """
    role_arn, arn = _text("requestParameters", "$.roleArn"), _identity("$.arn")
    assumed_role = (F.col("eventName") == "AssumeRole") & role_arn.contains(role_marker)
    issuer = "$.sessionContext.sessionIssuer.userName"
    return (
        F.when(assumed_role, F.substring_index(role_arn, role_marker, -1))
        .when((F.col("eventName") == "ConsoleLogin") & (_identity("$.type") == "Root"), "root")
        .when(_has("$.userName"), _identity("$.userName"))
        .when(_has("$.sessionContext"), F.when(_has(issuer), _identity(issuer)).otherwise(UNKNOWN))
        .when(_has("$.arn"), F.when(arn.contains("/"), F.substring_index(arn, "/", -1)).otherwise(UNKNOWN))
        .when(_has("$.principalId"), _identity("$.principalId"))
        .otherwise(UNKNOWN)
    )


def _json_text(part: str) -> Column:
    """JSON text of a part: ``null`` for a JSON null, ``{}`` when missing."""
    return F.coalesce(F.to_json(part), F.lit("{}"))


def parse_records(df: DataFrame, as_of: dt.datetime | None, role_marker: str = "/role/") -> DataFrame:
    """Parsed records from ``rec``; a time in no known format becomes ``as_of``.

    Without ``as_of`` such a record is unparsable, unless its envelope has a
    time.  Loading works that way: the time is part of an event's key, and a
    time that depends on the run would store a replayed record again.

    Without an id a record has no key; a record without time, with an identity
    that is no object or with an unreadable role cannot be used.  The record
    is opened in one step, and what later filters use is worked out once.
    """
    enveloped = "EventId" in df.columns
    event_id, event_name = F.col("eventID"), F.col("eventName")
    event_ts = parse_time(_text("eventTime"))
    event_ts = F.coalesce(event_ts, literal(as_of)) if as_of is not None else event_ts
    if enveloped:
        sent = F.col("_sent_time")
        sent = instant_to_utc(sent) if df.schema["EventTime"].dataType.typeName() == "timestamp" else sent
        df = df.withColumnsRenamed({"EventId": "_sent_id", "EventTime": "_sent_time", "EventName": "_sent_name"})
        event_id = F.coalesce("_sent_id", event_id)
        event_name = F.coalesce("_sent_name", event_name)
        event_ts = F.coalesce(sent, event_ts)
    role_unreadable = (
        (F.col("eventName") == "AssumeRole")
        & key_present(F.col("requestParameters"), "$.roleArn")
        & ~is_text(F.col("requestParameters"), "$.roleArn")
    )
    usable = (
        is_text(F.col("eventTime"))
        & (F.col("userIdentity").isNull() | is_object(F.col("userIdentity")))
        & _object_if_present("$.sessionContext")
        & _object_if_present("$.sessionContext.sessionIssuer")
        & ~F.coalesce(role_unreadable, F.lit(False))
        & not_blank(event_id)
    )
    derived = {
        "event_ts": event_ts,
        "user_name": user_name(role_marker),
        "identity_type": _identity("$.type"),
        "issuer_arn": _identity("$.sessionContext.sessionIssuer.arn"),
        "role_arn": _text("requestParameters", "$.roleArn"),
        "drop_reason": F.when(usable & event_ts.isNotNull(), None).otherwise(UNPARSABLE),
    }
    return (
        df.select("*", open_once(F.try_variant_get("rec", "$", RECORD), *RECORD_FIELDS))
        .select("*", open_once(F.struct(*[value.alias(name) for name, value in derived.items()]), *derived))
        .select(
            event_id.alias("event_id"),
            "event_ts",
            event_name.alias("event_name"),
            F.col("eventSource").alias("event_source"),
            F.col("awsRegion").alias("aws_region"),
            "user_name",
            F.col("sourceIPAddress").alias("source_ip"),
            F.col("userAgent").alias("user_agent"),
            _json_text("requestParameters").alias("request_parameters"),
            _json_text("responseElements").alias("response_elements"),
            F.col("errorCode").alias("error_code"),
            F.col("errorMessage").alias("error_message"),
            "identity_type",
            "issuer_arn",
            "role_arn",
            "drop_reason",
        )
    )


def kept(df: DataFrame) -> DataFrame:
    return df.where(F.col("drop_reason").isNull())


def event_type() -> Column:
    known = F.lit("other")
    for source, kind in EVENT_TYPES.items():
        known = F.when(F.col("event_source") == source, kind).otherwise(known)
    return known


def to_events(df: DataFrame, *extra: str) -> DataFrame:
    """Event rows of parsed records, with ``extra`` columns kept."""
    return df.withColumns({
        "event_date": F.substring(F.col("event_ts").cast("string"), 1, 10),
        "event_time": iso(F.col("event_ts")),
        "event_type": event_type(),
    }).select(*EVENT_COLUMNS, *extra)
