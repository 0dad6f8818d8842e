"""One positive and one negative row per rule, odd documents, repeats."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from accesslens.operators.alerts import active_sent, find_alerts, notices, sent_records, unsent

OWN = "111111111111"
NOW = dt.datetime(2024, 1, 31)


def found(make_events, name, params, own=OWN, strict=False, **event):
    text = params if isinstance(params, str) or params is None else json.dumps(params)
    rows = find_alerts(make_events({"event_name": name, "request_parameters": text, **event}), own, strict).collect()
    return [(row["rule_id"], row["alert_type"], row["alert_title"], row["alert_message"]) for row in rows]


def titles(*args, **kwargs):
    return [row[2] for row in found(*args, **kwargs)]


def found_for_all(make_events, cases, own=OWN):
    """Alerts of many (event name, parameters) cases from one pass, in order."""
    rows = [
        {
            "event_id": str(i),
            "event_name": name,
            "request_parameters": p if isinstance(p, str) or p is None else json.dumps(p),
            **(event[0] if event else {}),
        }
        for i, (name, p, *event) in enumerate(cases)
    ]
    result = [[] for _ in cases]
    for row in find_alerts(make_events(*rows), own).collect():
        result[int(row["event_id"])].append((row["rule_id"], row["alert_type"], row["alert_title"], row["alert_message"]))
    return result


def titles_for_all(make_events, cases):
    return [[alert[2] for alert in alerts] for alerts in found_for_all(make_events, cases)]


ADMIN_ARN = "arn:aws:iam::aws:policy/AdministratorAccess"
SET = "arn:aws:sso:::permissionSet/ssoins-1/ps-9"
CASES = [
    ("CreateUser", {"userName": "eve"}, "AL-02", "HIGH", "IAM User Created", "New IAM user 'eve' created by bob"),
    ("CreateUser", {"x": 1}, "AL-02", "HIGH", "IAM User Created", "New IAM user 'unknown' created by bob"),
    ("CreateUser", {"userName": None}, "AL-02", "HIGH", "IAM User Created", "New IAM user 'None' created by bob"),
    ("AttachUserPolicy", {"userName": "eve", "policyArn": ADMIN_ARN}, "AL-03", "CRITICAL", "Admin Policy Attached",
     "Admin policy AdministratorAccess attached to user 'eve' by bob"),
    ("CreateAccessKey", {"userName": "eve"}, "AL-05", "CRITICAL", "Access Key Created",
     "New access key created for user 'eve' by bob"),
    ("CreateAccessKey", "null", "AL-05", "CRITICAL", "Access Key Created", "New access key created for user 'bob' by bob"),
    ("CreateAccessKey", None, "AL-05", "CRITICAL", "Access Key Created", "New access key created for user 'bob' by bob"),
    ("UpdateAccessKey", {"userName": "eve", "status": "Inactive", "accessKeyId": "AKIA1234"}, "AL-07", "HIGH",
     "Access Key Updated", "Access key 1234 for user 'eve' changed to Inactive by bob"),
    ("DeleteVirtualMFADevice", {"serialNumber": "m1"}, "AL-08", "CRITICAL", "MFA Device Deleted",
     "Virtual MFA device m1 deleted by bob"),
    ("DeactivateMFADevice", {"serialNumber": "m1", "userName": "eve"}, "AL-08", "CRITICAL", "MFA Device Deactivated",
     "MFA device m1 deactivated for user 'eve' by bob"),
    ("CreatePermissionSet", {"name": "p", "instanceArn": "arn:0123456789", "sessionDuration": "PT1H"}, "AL-09", "CRITICAL",
     "SSO Permission Set Created",
     "New SSO permission set 'p' created by bob in instance 0123456789 with session duration PT1H"),
    ("UpdatePermissionSet", {"permissionSetArn": SET}, "AL-10", "CRITICAL", "SSO Permission Set Updated",
     "SSO permission set ps-9 updated by bob - Description: '', Session Duration: "),
    ("AttachManagedPolicyToPermissionSet", {"permissionSetArn": SET, "managedPolicyArn": "x/PowerUserAccess"}, "AL-11",
     "CRITICAL", "Admin Policy Attached to SSO Permission Set",
     "Admin policy PowerUserAccess attached to SSO permission set ps-9 by bob"),
    ("CreateAccountAssignment",
     {"targetId": "1", "targetType": "AWS_ACCOUNT", "principalId": "u", "principalType": "USER", "permissionSetArn": "flat"},
     "AL-12", "CRITICAL", "SSO Account Assignment Created",
     "SSO account assignment created by bob - USER u granted permission set flat on AWS_ACCOUNT 1"),
    ("CreateManagedApplicationInstance", {"displayName": "HIDDEN_DUE_TO_SECURITY_REASONS", "templateId": "t"}, "AL-13",
     "HIGH", "SSO Application Instance Created",
     "New SSO application instance 'unknown' created by bob - Template: t, URL: unknown"),
    ("DeleteManagedApplicationInstance", {"clientId": "c"}, "AL-14", "HIGH", "SSO Application Instance Deleted",
     "SSO application instance (client ID: c) deleted by bob"),
]


def test_rules_fire(make_events):
    assert found_for_all(make_events, [case[:2] for case in CASES]) == [[case[2:]] for case in CASES]


def test_rules_stay_silent(make_events):
    cases = [(case[0], empty) for case in CASES if case[0] != "CreateAccessKey" for empty in ("{}", "null", "broken", "[1]", None)]
    cases += [
        ("ListUsers", {"userName": "eve"}),
        ("AttachUserPolicy", {"policyArn": "x/ReadOnlyAccess"}),
        ("AttachUserPolicy", {"policyArn": None}),
        ("AttachRolePolicy", {"policyArn": ADMIN_ARN}),
        ("AttachManagedPolicyToPermissionSet", {"managedPolicyArn": "x/ReadOnlyAccess"}),
    ]
    assert found_for_all(make_events, cases) == [[]] * len(cases)


def test_first_listed_policy_is_reported(make_events):
    both = {"policyArn": "PowerUserAccess-IAMFullAccess", "userName": "e"}
    assert "Admin policy IAMFullAccess " in found(make_events, "AttachUserPolicy", both)[0][3]


LOGINS = [("root", None, ["Root Account Login"]), ("root", "", ["Root Account Login"]), ("root", "no", ["Failed Root Login"]),
          ("bob", "no", []), ("Root", None, [])]


def test_root_login(make_events):
    cases = [("ConsoleLogin", "null", {"user_name": user, "error_message": message}) for user, message, _ in LOGINS]
    assert titles_for_all(make_events, cases) == [expected for _, _, expected in LOGINS]


def allow(*actions, **statement):
    return [{"Effect": "Allow", "Action": action, **statement} for action in actions]


INLINE = [
    (allow("*"), "Full Admin Policy Attached"),
    (allow(["s3:Get*", "iam:*"]), "Full IAM Permissions Attached"),
    (allow(["s3:x"], ["sts:*", "*"]), "Full STS Permissions Attached"),
    ([{"Effect": "Deny", "Action": "*"}, {"Effect": "Allow", "Action": "iam:*"}], "Full IAM Permissions Attached"),
    ([{"Action": "*"}], None),
    ([{"Effect": "Allow"}], None),
    ([{"Effect": "Allow"}, *allow("*")], "Full Admin Policy Attached"),
    ([{"Effect": "Allow", "Action": None}, *allow("*")], None),
    (["text", *allow("*")], None),
    ([*allow("*"), "text"], "Full Admin Policy Attached"),
    (allow("*")[0], None),
    (allow("s3:*"), None),
]


def test_inline_policy(make_events):
    documents = [json.dumps({"Statement": statements}) for statements, _ in INLINE]
    cases = [("PutUserPolicy", {"policyName": "p", "userName": "e", "policyDocument": d}) for d in documents]
    assert titles_for_all(make_events, cases) == [[title] if title else [] for _, title in INLINE]


def test_unreadable_policy_documents(make_events):
    documents = ["", "broken", "[]", '"x"', {"Statement": allow("*")}, None, 5]
    cases = [("PutUserPolicy", {"userName": "e", "policyDocument": document}) for document in documents]
    assert titles_for_all(make_events, cases) == [[]] * len(cases)


ROOT, OTHER = f"arn:aws:iam::{OWN}:root", "arn:aws:iam::999999999999:root"
WILD, FOREIGN = "Role Trust Policy with Wildcard Principal", "Role Trust Policy with External Account"


PRINCIPALS = [
        ("*", WILD), ({"AWS": "*"}, WILD), ({"AWS": ["*"]}, None), ({"AWS": OTHER}, FOREIGN), ({"AWS": [ROOT, OTHER]}, FOREIGN),
        ({"AWS": ROOT}, None), ({"Service": "ec2.amazonaws.com"}, None), ({"AWS": "arn:aws:iam::9:user/x"}, None),
        ({"AWS": ["x:root", OTHER]}, None), ({"AWS": None}, None), ("text", None),
]


@pytest.mark.parametrize(
    "name, key", [("CreateRole", "assumeRolePolicyDocument"), ("UpdateAssumeRolePolicy", "policyDocument")]
)
def test_trust_policy(make_events, name, key):
    documents = [json.dumps({"Statement": [{"Effect": "Allow", "Principal": p}]}) for p, _ in PRINCIPALS]
    cases = [(name, {"roleName": "r", key: document}) for document in documents]
    assert titles_for_all(make_events, cases) == [[title] if title else [] for _, title in PRINCIPALS]


def test_trust_policy_order_and_options(make_events):
    statements = [{"Effect": "Allow", "Principal": {"AWS": OTHER}}, {"Effect": "Allow", "Principal": "*"}]
    params = {"roleName": "r", "assumeRolePolicyDocument": json.dumps({"Statement": statements})}
    assert found(make_events, "CreateRole", params) == [
        ("AL-06", "CRITICAL", FOREIGN, "Role 'r' allows access from external account 999999999999 - modified by bob")
    ]
    assert titles(make_events, "CreateRole", params, own="") == [WILD]
    listed = {"Statement": [{"Effect": "Allow", "Principal": {"AWS": ["*"]}}]}
    params = {"roleName": "r", "assumeRolePolicyDocument": json.dumps(listed)}
    assert titles(make_events, "CreateRole", params, strict=True) == [WILD]


@pytest.mark.parametrize(
    "event, count",
    [({"user_name": "unknown"}, 0), ({"event_id": ""}, 0), ({"event_id": None}, 0), ({"user_name": None}, 1), ({}, 1)],
)
def test_gate(make_events, event, count):
    assert len(found(make_events, "CreateAccessKey", "{}", **event)) == count


def test_disabled(make_events):
    assert find_alerts(make_events({"event_name": "CreateAccessKey"}), enabled=False).count() == 0


def test_sent_alerts_are_not_repeated_until_they_expire(spark, make_events):
    events = make_events(*[{"event_id": i, "event_name": "CreateAccessKey"} for i in ("a", "a", "b")])
    alerts = find_alerts(events)
    nothing = sent_records(notices(alerts), NOW).where("false")
    first = unsent(alerts, nothing, NOW)
    assert sorted(row["event_id"] for row in first.collect()) == ["a", "b"]
    sent = sent_records(notices(first), NOW)
    assert unsent(alerts, sent, NOW + dt.timedelta(days=29)).count() == 0
    assert unsent(alerts, sent, NOW + dt.timedelta(days=31)).count() == 2
    assert active_sent(sent, NOW + dt.timedelta(days=29)).count() == 2
    assert active_sent(sent, NOW + dt.timedelta(days=31)).count() == 0


def test_severity_is_part_of_the_key(make_events):
    alerts = find_alerts(make_events({"event_name": "CreateAccessKey"}))
    high = sent_records(notices(alerts.withColumn("alert_type", F.lit("HIGH"))), NOW)
    assert unsent(alerts, high, NOW).count() == 1


def test_notice_text(make_events):
    row = notices(find_alerts(make_events({"event_name": "CreateAccessKey", "source_ip": None}))).first()
    assert row["subject"] == "[CRITICAL] IAM Alert: Access Key Created"
    assert row["body"].splitlines()[1:6] == [
        "IAM Activity Alert: Access Key Created", "", "Severity: CRITICAL", "Time: 2024-01-30T10:00:00+00:00",
        "Region: us-east-1",
    ]
    assert "- Source IP: None\n- Event ID: e1\n" in row["body"]


def test_many_copies_are_limited_before_the_shuffle(make_events):
    alerts = find_alerts(make_events({"event_name": "CreateAccessKey"}))
    sent = sent_records(notices(alerts), NOW)
    plan = unsent(alerts, sent, NOW)._jdf.queryExecution().executedPlan().toString()
    assert "row_number(), 1, Partial" in plan
    assert plan.count("parseJson(request_parameters") <= 2  # once per use of the alerts
