"""Alert rules in one pass, de-duplication and notification texts.

A rule is a column that is an alert struct or NULL.  Rules read the request
parameters through one parsed map; events no rule looks at are filtered out by
name before anything is parsed.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from accesslens.fixed import (
    ADMIN_POLICIES,
    ALERT_MESSAGES,
    ALERT_RETENTION_DAYS,
    CRITICAL,
    DANGEROUS_ACTIONS,
    HIDDEN_NAME,
    HIGH,
    NOTICE_BODY,
    NOTICE_SUBJECT,
    ROOT,
    UNKNOWN,
)
from accesslens.functions.json import is_object, is_text, key_present, once
from accesslens.functions.text import fill, not_blank
from accesslens.functions.time import as_utc, epoch_seconds, literal
from accesslens.session import child_folders, remove_folder

STOP = "stop"


def _value(key: str) -> Column:
    return F.try_element_at("_params", F.lit(key))


def _param(key: str, default: str | Column = UNKNOWN) -> Column:
    """A request parameter as text; ``default`` only when the key is missing."""
    default = F.lit(default) if isinstance(default, str) else default
    value = _value(key)
    return (
        F.when(value.isNull(), default)
        .when(F.is_variant_null(value), "None")
        .otherwise(F.try_variant_get(value, "$", "string"))
    )


def _last_segment(text: Column) -> Column:
    return F.substring_index(text, "/", -1)


#: Event names that rules ask for, gathered as rules are written out.
_ASKED: set[str] = set()


def _event(*names: str) -> Column:
    _ASKED.update(names)
    return F.col("event_name").isin(list(names))


def _with_params(*names: str) -> Column:
    """One of these events with a non-empty parameter object."""
    return _event(*names) & F.coalesce(F.size("_params") > 0, F.lit(False))


def _alert(when: Column, rule: str, severity: str, title: str | Column, message: Column) -> Column:
    title = F.lit(title) if isinstance(title, str) else title
    return F.when(
        when,
        F.struct(
            F.lit(rule).alias("rule_id"),
            F.lit(severity).alias("alert_type"),
            title.alias("alert_title"),
            message.alias("alert_message"),
        ),
    )


def _message(name: str, /, **values: Column) -> Column:
    return fill(ALERT_MESSAGES[name], actor=F.col("user_name"), ip=F.col("source_ip"), **values)


def _admin_policy(arn: Column) -> Column:
    """The first administrator policy the ARN names."""
    return F.coalesce(*[F.when(arn.contains(name), F.lit(name)) for name in ADMIN_POLICIES])


def _first_finding(document: Column, finding) -> Column:
    """First non-NULL finding over a policy document's statements, in order.

    A statement that cannot be read stops the search: a finding before it
    counts, one behind it does not.
    """
    policy = F.when(is_text(document), F.try_parse_json(F.try_variant_get(document, "$", "string")))
    statements = F.try_variant_get(policy, "$.Statement", "array<variant>")
    allows = lambda s: F.coalesce(F.try_variant_get(s, "$.Effect", "string") == "Allow", F.lit(False))
    findings = F.transform(statements, lambda s: F.when(~is_object(s), STOP).when(allows(s), finding(s)))
    first = F.get(F.array_compact(findings), F.lit(0))
    return F.nullif(first, F.lit(STOP))


def _text_or_list(statement: Column, path: str) -> Column:
    """A JSON string or list of strings as an array, NULL for other kinds."""
    return F.coalesce(
        F.try_variant_get(statement, path, "array<string>"),
        F.when(is_text(statement, path), F.array(F.try_variant_get(statement, path, "string"))),
    )


def _dangerous_action(statement: Column) -> Column:
    actions = _text_or_list(statement, "$.Action")
    hit = F.get(F.filter(actions, lambda a: a.isin(list(DANGEROUS_ACTIONS))), F.lit(0))
    return F.when(key_present(statement, "$.Action") & actions.isNull(), STOP).otherwise(hit)


def _trust_finding(own_account: str, strict_wildcards: bool):
    """``*`` for an open principal, an account id for a foreign root."""

    def foreign_root(arn: Column) -> Column:
        account = F.get(F.split(arn, ":"), F.lit(4))
        found = F.when(account.isNull(), STOP).when((account != "") & (account != own_account), account)
        return F.when(arn.contains(":root") & F.lit(bool(own_account)), found)

    def finding(statement: Column) -> Column:
        principals = _text_or_list(statement, "$.Principal.AWS")
        wildcard = is_text(statement, "$.Principal") & (F.try_variant_get(statement, "$.Principal", "string") == "*")
        wildcard |= is_text(statement, "$.Principal.AWS") & (
            F.try_variant_get(statement, "$.Principal.AWS", "string") == "*"
        )
        if strict_wildcards:
            wildcard |= F.coalesce(F.array_contains(principals, "*"), F.lit(False))
        foreign = F.get(F.array_compact(F.transform(principals, foreign_root)), F.lit(0))
        unreadable = key_present(statement, "$.Principal.AWS") & principals.isNull()
        return F.when(F.coalesce(wildcard, F.lit(False)), "*").when(unreadable, STOP).otherwise(foreign)

    return finding


def _finding(own_account: str, strict_wildcards: bool) -> Column:
    """What a policy event grants: policy name, action, ``*`` or account."""
    action = _first_finding(_value("policyDocument"), _dangerous_action)
    trust_document = F.when(_event("CreateRole"), _value("assumeRolePolicyDocument")).otherwise(_value("policyDocument"))
    trust = _first_finding(trust_document, _trust_finding(own_account, strict_wildcards))
    return (
        F.when(_with_params("AttachUserPolicy"), _admin_policy(F.try_variant_get(_value("policyArn"), "$", "string")))
        .when(
            _with_params("AttachManagedPolicyToPermissionSet"),
            _admin_policy(F.try_variant_get(_value("managedPolicyArn"), "$", "string")),
        )
        .when(_with_params("PutUserPolicy"), action)
        .when(_with_params("CreateRole", "UpdateAssumeRolePolicy"), trust)
    )


def rules() -> list[Column]:
    """All alert rules over ``_params`` and ``_finding``."""
    root_login = (F.col("user_name") == ROOT) & _event("ConsoleLogin")
    login_failed = not_blank(F.col("error_message"))
    finding = F.col("_finding")
    set_id = _last_segment(_param("permissionSetArn"))
    shown = F.when(_param("displayName") == HIDDEN_NAME, UNKNOWN).otherwise(_param("displayName"))
    target, serial = _param("userName"), _param("serialNumber")

    def inline(action: str) -> Column:
        title, scope = DANGEROUS_ACTIONS[action]
        text = _message("inline_policy", name=_param("policyName"), scope=F.lit(scope), target=target)
        return _alert(_event("PutUserPolicy") & (finding == action), "AL-04", CRITICAL, title, text)

    trusting = _event("CreateRole", "UpdateAssumeRolePolicy")
    return [
        _alert(root_login & login_failed, "AL-01", CRITICAL, "Failed Root Login", _message("root_login_failed")),
        _alert(root_login & ~login_failed, "AL-01", CRITICAL, "Root Account Login", _message("root_login")),
        _alert(
            _with_params("CreateUser"), "AL-02", HIGH, "IAM User Created", _message("user_created", target=target)
        ),
        _alert(
            _event("AttachUserPolicy") & finding.isNotNull(), "AL-03", CRITICAL, "Admin Policy Attached",
            _message("admin_policy", policy=finding, target=target),
        ),
        *[inline(name) for name in DANGEROUS_ACTIONS],
        _alert(
            _event("CreateAccessKey"), "AL-05", CRITICAL, "Access Key Created",
            _message("key_created", target=_param("userName", F.col("user_name"))),
        ),
        _alert(
            trusting & (finding == "*"), "AL-06", CRITICAL, "Role Trust Policy with Wildcard Principal",
            _message("trust_wildcard", role=_param("roleName")),
        ),
        _alert(
            trusting & (finding != "*"), "AL-06", CRITICAL, "Role Trust Policy with External Account",
            _message("trust_external", role=_param("roleName"), account=finding),
        ),
        _alert(
            _with_params("UpdateAccessKey"), "AL-07", HIGH, "Access Key Updated",
            _message("key_updated", key=F.right(_param("accessKeyId"), F.lit(4)), target=target, status=_param("status")),
        ),
        _alert(
            _with_params("DeleteVirtualMFADevice"), "AL-08", CRITICAL, "MFA Device Deleted",
            _message("mfa_deleted", serial=serial),
        ),
        _alert(
            _with_params("DeactivateMFADevice"), "AL-08", CRITICAL, "MFA Device Deactivated",
            _message("mfa_deactivated", serial=serial, target=target),
        ),
        _alert(
            _with_params("CreatePermissionSet"), "AL-09", CRITICAL, "SSO Permission Set Created",
            _message(
                "set_created", name=_param("name"), instance=F.right(_param("instanceArn"), F.lit(10)),
                duration=_param("sessionDuration"),
            ),
        ),
        _alert(
            _with_params("UpdatePermissionSet"), "AL-10", CRITICAL, "SSO Permission Set Updated",
            _message(
                "set_updated", set_id=set_id, description=_param("description", ""),
                duration=_param("sessionDuration", ""),
            ),
        ),
        _alert(
            _event("AttachManagedPolicyToPermissionSet") & finding.isNotNull(), "AL-11", CRITICAL,
            "Admin Policy Attached to SSO Permission Set", _message("set_admin_policy", policy=finding, set_id=set_id),
        ),
        _alert(
            _with_params("CreateAccountAssignment"), "AL-12", CRITICAL, "SSO Account Assignment Created",
            _message(
                "assignment", principal_type=_param("principalType"), principal=_param("principalId"), set_id=set_id,
                target_type=_param("targetType"), target=_param("targetId"),
            ),
        ),
        _alert(
            _with_params("CreateManagedApplicationInstance"), "AL-13", HIGH, "SSO Application Instance Created",
            _message("app_created", name=shown, template=_param("templateId"), url=_param("startUrl")),
        ),
        _alert(
            _with_params("DeleteManagedApplicationInstance"), "AL-14", HIGH, "SSO Application Instance Deleted",
            _message("app_deleted", client=_param("clientId")),
        ),
    ]


def find_alerts(
    events: DataFrame, own_account: str = "", strict_wildcards: bool = False, enabled: bool = True
) -> DataFrame:
    """One row per alert of event rows.

    Foreign-account trust is judged only where ``own_account`` is given.
    ``strict_wildcards`` also treats ``*`` inside a principal list as open.
    """
    found = F.inline(F.array_compact(F.array(*rules())))
    gate = (
        F.lit(enabled)
        & ~F.col("user_name").eqNullSafe(UNKNOWN)
        & not_blank(F.col("event_id"))
        & F.col("event_name").isin(sorted(_ASKED))
        & ((F.col("event_name") != "ConsoleLogin") | (F.col("user_name") == ROOT))
    )
    params = F.try_variant_get(F.try_parse_json("request_parameters"), "$", "map<string,variant>")
    context = [
        "event_id", "event_date", "event_time", "event_name", "user_name", "source_ip", "aws_region",
    ]
    return (
        events.where(gate)
        .select(*context, "error_message", once(params).alias("_params"))
        .select("*", once(_finding(own_account, strict_wildcards)).alias("_finding"))
        .select(*context, found)
    )


def unsent(alerts: DataFrame, sent: DataFrame, now: dt.datetime) -> DataFrame:
    """Alerts not sent for their event and severity in the retention time.

    Copies of an event inside the batch alert once.  The row-number filter
    keeps one row per key map-side already, so a key with many copies does
    not meet in one task.
    """
    order = W.partitionBy("event_id", "alert_type").orderBy("event_time", "rule_id", "alert_message")
    once_each = alerts.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")
    return once_each.join(active_sent(sent, now).select("event_id", "alert_type"), ["event_id", "alert_type"], "left_anti")


def active_sent(sent: DataFrame, now: dt.datetime) -> DataFrame:
    """Sent alerts whose retention has not run out.

    The alert table is partitioned by the day of sending, so older days are
    not read.
    """
    oldest = (as_utc(now) - dt.timedelta(days=ALERT_RETENTION_DAYS)).date().isoformat()
    return sent.where((F.col("sent_date") >= oldest) & (F.col("ttl") > epoch_seconds(now)))


def expire_alerts(spark: SparkSession, path: str, now: dt.datetime) -> list[str]:
    """Remove the days of sent alerts whose retention has run out.

    The alert table is partitioned by the day of sending, so this drops
    folders and reads no rows.  Returns the days removed.
    """
    oldest = (as_utc(now) - dt.timedelta(days=ALERT_RETENTION_DAYS)).date().isoformat()
    gone = [name for name in child_folders(spark, path) if name.startswith("sent_date=") and name[10:] < oldest]
    for name in gone:
        remove_folder(spark, f"{path}/{name}")
    return [name[10:] for name in gone]


def notices(alerts: DataFrame) -> DataFrame:
    """Alerts with message id, subject and body of their notification."""
    return alerts.select(
        "*",
        F.sha2(F.concat_ws("|", "event_id", "alert_type", "alert_title"), 256).alias("message_id"),
        F.coalesce("event_name", F.lit(UNKNOWN)).alias("event_name_attribute"),
        fill(NOTICE_SUBJECT, severity=F.col("alert_type"), title=F.col("alert_title")).alias("subject"),
        fill(
            NOTICE_BODY,
            title=F.col("alert_title"),
            severity=F.col("alert_type"),
            time=F.col("event_time"),
            region=F.col("aws_region"),
            message=F.col("alert_message"),
            event_name=F.col("event_name"),
            actor=F.col("user_name"),
            ip=F.col("source_ip"),
            event_id=F.col("event_id"),
        ).alias("body"),
    )


def sent_records(due: DataFrame, now: dt.datetime) -> DataFrame:
    """Notices stamped as sent, with the end of their retention."""
    return due.withColumns({
        "sent_date": F.lit(as_utc(now).date().isoformat()),
        "sent_timestamp": literal(now),
        "ttl": F.lit(epoch_seconds(now + dt.timedelta(days=ALERT_RETENTION_DAYS))).cast("bigint"),
    })
