"""Hand-written records; expected values follow the documented rules."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from accesslens.operators.normalize import kept, parse_records, to_events
from accesslens.sources.raw import from_text, read_envelopes, read_records

NOW = dt.datetime(2024, 1, 31, 12)


def record(**parts):
    base = {
        "eventID": "e1", "eventTime": "2024-01-30T10:00:00Z", "eventName": "ListUsers",
        "eventSource": "iam.amazonaws.com", "awsRegion": "us-east-1", "userIdentity": {"userName": "bob"},
    }
    return {key: value for key, value in {**base, **parts}.items() if value != "ABSENT"}


def parse(spark, *records, **options):
    rows = [(item if isinstance(item, str) else json.dumps(item),) for item in records]
    return parse_records(from_text(spark.createDataFrame(rows, "raw string")), NOW, **options)


USER_NAMES = [
        ({"eventName": "AssumeRole", "requestParameters": {"roleArn": "arn:aws:iam::1/role/team/X"}}, "team/X"),
        ({"eventName": "AssumeRole", "requestParameters": {"roleArn": "a/role/b/role/X"}}, "X"),
        ({"eventName": "AssumeRole", "requestParameters": {"roleArn": "arn:aws:iam::1:role/X"}}, "bob"),
        ({"eventName": "ConsoleLogin", "userIdentity": {"type": "Root", "userName": "x"}}, "root"),
        ({"eventName": "ConsoleLogin", "userIdentity": {"type": "IAMUser", "userName": "carl"}}, "carl"),
        ({"eventName": "ConsoleLogin", "userIdentity": {"type": "SAMLUser"}}, "unknown"),
        ({"userIdentity": {"type": "Root"}}, "unknown"),
        ({"userIdentity": {"userName": "x", "arn": "a/b"}}, "x"),
        ({"userIdentity": {"userName": None, "arn": "a/b"}}, None),
        ({"userIdentity": {"sessionContext": {"sessionIssuer": {"userName": "role1"}}}}, "role1"),
        ({"userIdentity": {"sessionContext": {"sessionIssuer": {}}, "arn": "a/b"}}, "unknown"),
        ({"userIdentity": {"sessionContext": {}, "arn": "a/b", "principalId": "P"}}, "unknown"),
        ({"userIdentity": {"arn": "arn:aws:iam::1:user/t/alice"}}, "alice"),
        ({"userIdentity": {"arn": "plain", "principalId": "P"}}, "unknown"),
        ({"userIdentity": {"principalId": "P"}}, "P"),
        ({"userIdentity": {}}, "unknown"),
        ({"userIdentity": "ABSENT"}, "unknown"),
]


def test_user_name(spark):
    rows = parse(spark, *[record(**parts) for parts, _ in USER_NAMES]).collect()
    assert [(row["user_name"], row["drop_reason"]) for row in rows] == [(name, None) for _, name in USER_NAMES]


def test_role_marker_option(spark):
    item = record(eventName="AssumeRole", requestParameters={"roleArn": "arn:aws:iam::1:role/team/X"})
    assert parse(spark, item, role_marker=":role/").first()["user_name"] == "team/X"


@pytest.mark.parametrize(
    "item",
    [
        "not json", "[1,2]", "7", record(eventTime="ABSENT"), record(eventTime=None), record(eventTime=5),
        record(userIdentity=None), record(userIdentity="text"), record(userIdentity={"sessionContext": None}),
        record(userIdentity={"sessionContext": {"sessionIssuer": None}}), record(eventID="ABSENT"),
        record(eventName="AssumeRole", requestParameters={"roleArn": None}),
    ],
)
def test_unusable_records_are_flagged(spark, item):
    assert [row["drop_reason"] for row in parse(spark, item, record()).collect()] == ["unparsable", None]


@pytest.mark.parametrize(
    "value, expected",
    [("ABSENT", "{}"), (None, "null"), ({}, "{}"), ({"a": {"b": [1, "x"]}}, '{"a":{"b":[1,"x"]}}')],
)
def test_parameter_text(spark, value, expected):
    row = parse(spark, record(requestParameters=value, responseElements=value)).first()
    assert (row["request_parameters"], row["response_elements"]) == (expected, expected)


@pytest.mark.parametrize(
    "time, expected",
    [
        ("2025-08-10T18:26:07Z", "2025-08-10T18:26:07+00:00"),
        ("2025-08-10T18:26:07.123Z", "2025-08-10T18:26:07.123000+00:00"),
        ("2025-08-10 18:26:07", "2025-08-10T18:26:07+00:00"),
        ("soon", "2024-01-31T12:00:00+00:00"),
    ],
)
def test_event_time(spark, time, expected):
    row = to_events(parse(spark, record(eventTime=time))).first()
    assert (row["event_time"], row["event_date"]) == (expected, expected[:10])


@pytest.mark.parametrize(
    "source, kind",
    [("iam", "iam"), ("sts", "sts"), ("signin", "signin"), ("sso", "sso"), ("ec2", "other")],
)
def test_event_type(spark, source, kind):
    assert to_events(parse(spark, record(eventSource=f"{source}.amazonaws.com"))).first()["event_type"] == kind


def test_absent_optional_fields_stay_null(spark):
    row = to_events(parse(spark, record())).first()
    assert (row["error_code"], row["error_message"], row["source_ip"], row["user_agent"]) == (None,) * 4


def test_record_files(spark, tmp_path):
    (tmp_path / "deep" / "er").mkdir(parents=True)
    (tmp_path / "deep" / "a.json").write_text(json.dumps({"Records": [record(), record(eventID="e2")]}, indent=1))
    (tmp_path / "deep" / "er" / "b.json").write_text(json.dumps({"Records": [record(eventID="e3")]}))
    found = to_events(kept(parse_records(read_records(spark, str(tmp_path)), NOW)))
    assert sorted(row["event_id"] for row in found.collect()) == ["e1", "e2", "e3"]
    future = read_records(spark, str(tmp_path), modified_after=dt.datetime(2999, 1, 1))
    assert future.count() == 0


def test_one_broken_record_or_file_leaves_the_rest_alone(spark, tmp_path):
    good, twice = json.dumps(record()), '{"eventID":"e2","eventID":"e2","eventTime":"2024-01-30T10:00:00Z"}'
    (tmp_path / "a.json").write_text(f'{{"Records": [{good}, {twice}]}}')
    (tmp_path / "b.json").write_text('{"Records": [{"eventID": ')
    (tmp_path / "c.json").write_text('{"Records": []}')
    parsed = parse_records(read_records(spark, str(tmp_path)), NOW)
    assert sorted(str(row["drop_reason"]) for row in parsed.collect()) == ["None", "unparsable", "unparsable"]


def test_envelope_values_win(spark, tmp_path):
    line = {
        "EventId": "env", "EventTime": "2024-01-29T08:00:00.000+02:00", "EventName": "Renamed",
        "CloudTrailEvent": json.dumps(record(userIdentity={"principalId": "P"})),
    }
    bare = {"CloudTrailEvent": json.dumps(record(eventID="inner"))}
    (tmp_path / "x.json").write_text("\n".join(json.dumps(item) for item in (line, bare)))
    rows = to_events(kept(parse_records(read_envelopes(spark, str(tmp_path)), NOW))).orderBy("event_id").collect()
    assert [(r["event_id"], r["event_time"], r["event_name"], r["user_name"]) for r in rows] == [
        ("env", "2024-01-29T06:00:00+00:00", "Renamed", "P"),
        ("inner", "2024-01-30T10:00:00+00:00", "ListUsers", "bob"),
    ]


def test_record_is_parsed_once(spark):
    parsed = parse(spark, record()).where(F.col("user_name") != "x").where("drop_reason IS NULL")
    assert parsed._jdf.queryExecution().executedPlan().toString().count("parseJson") == 1
