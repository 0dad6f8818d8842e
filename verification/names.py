"""Name lists of the statements, written out apart from the engine's, so that a
wrong name on either side shows."""

# Event and policy names, as SQL lists.
SIGN_IN = "'AssumeRole', 'ConsoleLogin', 'GetSessionToken'"
SSO_ADMIN = "'AttachManagedPolicyToPermissionSet', 'CreateAccountAssignment', 'CreatePermissionSet', 'UpdatePermissionSet'"
SSO_APPS = "'CreateManagedApplicationInstance', 'DeleteManagedApplicationInstance'"
IAM_CHANGES_BY_USER = (
    "'AttachGroupPolicy', 'AttachRolePolicy', 'AttachUserPolicy', 'CreateRole', 'CreateUser', 'DeleteRole', 'DeleteUser', "
    "'DeleteUserPolicy', 'DetachGroupPolicy', 'DetachRolePolicy', 'DetachUserPolicy', 'PutUserPolicy'"
)
IAM_CHANGES = f"{IAM_CHANGES_BY_USER}, 'DeleteRolePolicy', 'PutRolePolicy'"
#: In the order in which the first that occurs is reported.
ADMIN_POLICIES = (
    "AdministratorAccess", "IAMFullAccess", "PowerUserAccess",
    "AWSSSOMasterAccountAdministrator", "AWSIdentityCenterFullAccess", "AWSSSOMemberAccountAdministrator",
)
