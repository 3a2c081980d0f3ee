"""Secret rules, written from the publicly documented token formats.

Every pattern has one capture group: the secret itself.  Only the masked form
of that group ever leaves the scanner.
"""

from __future__ import annotations

from .model import SecretRule

SECRET_RULES: tuple[SecretRule, ...] = (
    SecretRule("aws-access-key", r"\b((?:AKIA|ASIA)[0-9A-Z]{16})\b", (("akia", "asia"),),
               ignore_case=False, value_group=1, secret_type="aws_access_key",
               description="AWS Access Key ID detected"),
    SecretRule("aws-secret-key",
               r"""aws_?secret_?(?:access_?)?key["']?\s*[:=]\s*["']([A-Za-z0-9/+=]{40})["']""",
               (("secret",), ("aws",)), value_group=1, secret_type="aws_secret_key",
               description="AWS Secret Access Key detected"),
    SecretRule("gcp-api-key", r"\b(AIza[0-9A-Za-z_\-]{35})", (("aiza",),),
               ignore_case=False, value_group=1, secret_type="gcp_api_key",
               description="Google Cloud API key detected"),
    SecretRule("azure-storage-key", r"AccountKey=([A-Za-z0-9+/]{86}==)", (("accountkey=",),),
               value_group=1, secret_type="azure_storage_key",
               description="Azure storage account key detected"),
    SecretRule("github-token", r"\b(gh[pousr]_[A-Za-z0-9]{36})\b", (("ghp_", "gho_", "ghu_", "ghs_", "ghr_"),),
               ignore_case=False, value_group=1, secret_type="github_token",
               description="GitHub token detected"),
    SecretRule("gitlab-token", r"\b(glpat-[A-Za-z0-9_\-]{20})", (("glpat-",),),
               ignore_case=False, value_group=1, secret_type="gitlab_token",
               description="GitLab personal access token detected"),
    SecretRule("slack-token", r"\b(xox[abprs]-[A-Za-z0-9\-]{10,})", (("xox",),),
               ignore_case=False, value_group=1, secret_type="slack_token",
               description="Slack token detected"),
    SecretRule("discord-token",
               r"discord[^\n]{0,80}?\b([MN][A-Za-z0-9]{23}\.[A-Za-z0-9_\-]{6}\.[A-Za-z0-9_\-]{27})", (("discord",),),
               value_group=1, secret_type="discord_token", description="Discord bot token detected"),
    SecretRule("stripe-key", r"\b([sr]k_(?:live|test)_[0-9A-Za-z]{16,})", (("k_live_", "k_test_"),),
               ignore_case=False, value_group=1, secret_type="stripe_key",
               description="Stripe API key detected"),
    SecretRule("generic-api-key",
               r"""\b(?:api[_\-]?key|access[_\-]?token|auth[_\-]?token|token|secret)["']?\s*[:=]\s*["']([A-Za-z0-9_\-]{16,})["']""",
               (("key", "token", "secret"), ('"', "'")), value_group=1, secret_type="generic_api_key",
               description="Generic API key or token assignment detected", confidence=0.8),
    SecretRule("private-key", r"(-----BEGIN (?:[A-Z]+ ){0,4}PRIVATE KEY-----)", (("private key-----",),),
               ignore_case=False, value_group=1, secret_type="private_key",
               description="Private key block detected"),
    SecretRule("connection-string",
               r"""\b((?:postgres|postgresql|mysql|mongodb|redis|amqp)://[^\s:@/"']+:[^\s:@/"']+@[^\s"']+)""",
               (("://",), ("@",)), value_group=1, secret_type="connection_string",
               description="Connection string with embedded credentials detected"),
    SecretRule("password",
               r"""\b(?:password|passwd|pwd)["']?\s*[:=]\s*["']([^"'\s]{6,})["']""",
               (("passw", "pwd"), ('"', "'")), value_group=1, secret_type="password",
               description="Hardcoded password detected", confidence=0.8),
    SecretRule("high-entropy",
               r"""["']([A-Za-z0-9+/=_\-]{20,})["']""",
               (('"', "'"),), value_group=1, secret_type="high_entropy_string",
               description="High-entropy string detected", confidence=0.6, min_entropy=3.5),
)
