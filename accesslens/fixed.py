"""Names, formats and rates that results depend on."""

# Literals stored in event rows.
UNKNOWN = "unknown"
ROOT = "root"
HIDDEN_NAME = "HIDDEN_DUE_TO_SECURITY_REASONS"
SERVICE_DOMAIN = ".amazonaws.com"
SERVICE_ROLE_PATH = "/aws-service-role/"

# Event source -> event type ("other" for the rest).
EVENT_TYPES = {
    "iam.amazonaws.com": "iam",
    "sts.amazonaws.com": "sts",
    "signin.amazonaws.com": "signin",
    "sso.amazonaws.com": "sso",
}

# Event names selected by the queries.
SIGN_IN_EVENTS = ["ConsoleLogin", "AssumeRole", "GetSessionToken"]
PERMISSION_EVENTS = [
    "AttachUserPolicy", "DetachUserPolicy",
    "AttachGroupPolicy", "DetachGroupPolicy",
    "AttachRolePolicy", "DetachRolePolicy",
    "CreateUser", "DeleteUser",
    "CreateRole", "DeleteRole",
    "PutUserPolicy", "DeleteUserPolicy",
    "PutRolePolicy", "DeleteRolePolicy",
]
ADHOC_PERMISSION_EVENTS = [
    "AttachUserPolicy", "DetachUserPolicy",
    "AttachGroupPolicy", "DetachGroupPolicy",
    "AttachRolePolicy", "DetachRolePolicy",
    "CreateUser", "DeleteUser",
    "CreateRole", "DeleteRole",
    "PutUserPolicy", "DeleteUserPolicy",
]
PERMISSION_SET_EVENTS = ["CreatePermissionSet", "UpdatePermissionSet"]
ASSIGNMENT_EVENTS = ["CreateAccountAssignment", "DeleteAccountAssignment"]
POLICY_ATTACH_EVENT = "AttachManagedPolicyToPermissionSet"
APPLICATION_EVENTS = ["CreateManagedApplicationInstance", "DeleteManagedApplicationInstance"]
APPLICATION_STATUS_EVENT = "UpdateManagedApplicationInstanceStatus"
SSO_ADMIN_EVENTS = [
    "CreatePermissionSet", "UpdatePermissionSet", "AttachManagedPolicyToPermissionSet",
    "CreateAccountAssignment",
]
CRITICAL_POLICIES = ["AdministratorAccess", "PowerUserAccess", "IAMFullAccess"]
TARGET_FIELDS = ["userName", "roleName", "groupName", "policyName", "policyArn"]
TARGET_SEPARATOR = " → "

# Policy names that make an attachment an administrator grant,
# in reporting order.
ADMIN_POLICIES = [
    "AdministratorAccess",
    "IAMFullAccess",
    "PowerUserAccess",
    "AWSSSOMasterAccountAdministrator",
    "AWSIdentityCenterFullAccess",
    "AWSSSOMemberAccountAdministrator",
]

# Inline-policy actions that alert -> (title, permission wording).
DANGEROUS_ACTIONS = {
    "*": ("Full Admin Policy Attached", "full admin (*:*)"),
    "iam:*": ("Full IAM Permissions Attached", "full IAM"),
    "sts:*": ("Full STS Permissions Attached", "full STS"),
}

CRITICAL = "CRITICAL"
HIGH = "HIGH"

# Alert message formats.
ALERT_MESSAGES = {
    "root_login_failed": "Failed root login attempt from IP: {ip}",
    "root_login": "Root account logged in from IP: {ip}",
    "user_created": "New IAM user '{target}' created by {actor}",
    "admin_policy": "Admin policy {policy} attached to user '{target}' by {actor}",
    "inline_policy": "Policy '{name}' with {scope} permissions attached to user '{target}' by {actor}",
    "key_created": "New access key created for user '{target}' by {actor}",
    "trust_wildcard": "Role '{role}' created/updated with trust policy allowing ANY principal by {actor}",
    "trust_external": "Role '{role}' allows access from external account {account} - modified by {actor}",
    "key_updated": "Access key {key} for user '{target}' changed to {status} by {actor}",
    "mfa_deleted": "Virtual MFA device {serial} deleted by {actor}",
    "mfa_deactivated": "MFA device {serial} deactivated for user '{target}' by {actor}",
    "set_created": "New SSO permission set '{name}' created by {actor} in instance {instance} "
                   "with session duration {duration}",
    "set_updated": "SSO permission set {set_id} updated by {actor} - Description: '{description}', "
                   "Session Duration: {duration}",
    "set_admin_policy": "Admin policy {policy} attached to SSO permission set {set_id} by {actor}",
    "assignment": "SSO account assignment created by {actor} - {principal_type} {principal} granted "
                  "permission set {set_id} on {target_type} {target}",
    "app_created": "New SSO application instance '{name}' created by {actor} - Template: {template}, URL: {url}",
    "app_deleted": "SSO application instance (client ID: {client}) deleted by {actor}",
}

# Notification layout.
NOTICE_SUBJECT = "[{severity}] IAM Alert: {title}"
NOTICE_BODY = """
IAM Activity Alert: {title}

Severity: {severity}
Time: {time}
Region: {region}

{message}

Event Details:
- Event Name: {event_name}
- User: {actor}
- Source IP: {ip}
- Event ID: {event_id}

Action Required: Review this activity immediately in CloudTrail.
"""
ALERT_RETENTION_DAYS = 30

# Storage prices in USD per GB and month, and the age in days
# at which data moves to a colder class.
STORAGE_PRICES = {
    "STANDARD": 0.023,
    "STANDARD_IA": 0.0125,
    "GLACIER": 0.004,
    "DEEP_ARCHIVE": 0.00099,
}
DEFAULT_STORAGE_CLASS = "STANDARD"
STORAGE_TIERS = {"DEEP_ARCHIVE": 365, "GLACIER": 90, "STANDARD_IA": 30}
SCAN_PRICE_PER_TB = 5.0
