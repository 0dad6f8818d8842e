import datetime as dt
import json

import pytest

from accesslens.operators.filters import filter_events, filtered_role, flag_noise
from accesslens.operators.normalize import parse_records
from accesslens.sources.raw import from_text
from accesslens.sources.routes import Routes, checkpoint_key, route_table, select_by_table, select_sources


def parsed(spark, **parts):
    item = {"eventID": "1", "eventTime": "2024-01-30T10:00:00Z", "eventName": "AssumeRole", **parts}
    return parse_records(from_text(spark.createDataFrame([(json.dumps(item),)], "raw string")), dt.datetime(2024, 1, 31))


SERVICE_ROLE = {"roleArn": "arn:aws:iam::1:role/aws-service-role/x"}
AWS = {"type": "AWSService"}


@pytest.mark.parametrize(
    "parts, reason",
    [
        ({"userIdentity": {"sessionContext": {"sessionIssuer": {"arn": "x/aws-service-role/y"}}}}, "service"),
        ({"userIdentity": AWS, "userAgent": "a.amazonaws.com", "requestParameters": SERVICE_ROLE}, "service"),
        ({"userIdentity": AWS, "sourceIPAddress": "a.amazonaws.com", "requestParameters": SERVICE_ROLE}, "service"),
        ({"userIdentity": AWS, "userAgent": "cli", "sourceIPAddress": "1.1.1.1", "requestParameters": SERVICE_ROLE}, None),
        ({"userIdentity": AWS, "requestParameters": SERVICE_ROLE}, None),
        ({"userIdentity": AWS, "userAgent": "a.amazonaws.com", "requestParameters": {"roleArn": "role/x"}}, None),
        ({"userIdentity": AWS, "userAgent": "a.amazonaws.com", "requestParameters": None}, None),
        ({"userIdentity": {"type": "Root"}, "userAgent": "a.amazonaws.com", "requestParameters": SERVICE_ROLE}, None),
        ({}, None),
    ],
)
def test_service_noise(spark, parts, reason):
    assert flag_noise(parsed(spark, **parts)).first()["drop_reason"] == reason
    assert flag_noise(parsed(spark, **parts), drop_services=False).first()["drop_reason"] is None


@pytest.mark.parametrize(
    "roles, text, hit",
    [
        ("Audit", "Audit", True), ("Audit", "arn:aws:iam::1:role/Audit", True), ("Audit", "Audit/session", True),
        ("Audit", "x/Audit/y", True), ("Audit", "Auditor", False), ("audit", "AUDIT", True),
        ("CSPM-*", "arn:aws:iam::1:role/CSPM-Scan", True), ("CSPM-*", "arn:aws:iam::1:role/MyCSPM-Scan", False),
        ("*Scanner*", "arn:aws:iam::1:role/MyScannerRole", True), ("a.c", "abc", False), ("a.c", "a.c", True),
        ("arn:aws:iam::1:role/R*", "arn:aws:iam::1:role/R2", True),
        ("arn:aws:iam::1:role/R", "arn:aws:iam::1:role/R2", False),
        (" Other , Audit ,", "Audit", True), ("", "Audit", False), (None, "Audit", False), ("x(", "x(", True),
    ],
)
def test_role_patterns(spark, roles, text, hit):
    df = spark.createDataFrame([("AssumeRole", text, "u")], "event_name string, role_arn string, user_name string")
    assert df.select(filtered_role(roles).alias("x")).first()["x"] is hit
    df = spark.createDataFrame([("Other", "n", text)], "event_name string, role_arn string, user_name string")
    assert df.select(filtered_role(roles).alias("x")).first()["x"] is hit


def test_role_arn_counts_for_assume_role_only(spark):
    df = spark.createDataFrame([("GetUser", "Audit", None)], "event_name string, role_arn string, user_name string")
    assert df.select(filtered_role("Audit").alias("x")).first()["x"] is False


def test_service_reason_comes_first(spark):
    identity = {"userName": "Audit", "sessionContext": {"sessionIssuer": {"arn": "x/aws-service-role/y"}}}
    assert flag_noise(parsed(spark, userIdentity=identity), roles="Audit").first()["drop_reason"] == "service"


def test_kept_and_filtered_add_up(spark, events):
    inside = filter_events(events, "Role1,*session-1*")
    assert inside.columns == events.columns
    assert 0 < inside.count() < events.count()
    assert inside.count() + events.join(inside, ["event_id"], "left_anti").count() == events.count()


def test_routes_predicate_and_table_agree(spark, events):
    routes = Routes(regions=["us-east-1", "eu-west-1"], sso_region="eu-west-1", sign_in=False)
    by_predicate = select_sources(events, routes)
    by_table = select_by_table(events, route_table(spark, routes))
    assert by_predicate.count() == by_table.count() > 0
    assert by_predicate.where("event_type = 'signin'").count() == 0
    assert by_predicate.where("event_type = 'iam' AND aws_region <> 'us-east-1'").count() == 0


def test_checkpoint_keys(spark):
    keys = route_table(spark, Routes(regions=["eu-west-1"], sso_region="eu-west-1"))
    assert sorted(row["checkpoint_key"] for row in keys.collect()) == [
        "iam-events", "signin-events", "sso-eu-west-1", "sso-us-east-1", "sts-eu-west-1",
    ]
    other = spark.createDataFrame([("ec2.amazonaws.com", "x")], "event_source string, aws_region string")
    assert other.select(checkpoint_key().alias("k")).first()["k"] is None


def test_routing_reaches_the_scan(spark, events, tmp_path):
    path = str(tmp_path / "e")
    events.write.parquet(path)
    plan = select_sources(spark.read.parquet(path), Routes())._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [Or(" in plan or "PushedFilters: [IsNotNull" in plan
