from .code_rules import CODE_RULES
from .load import rules_from_table
from .model import CodeRule, OwaspCheck, OwaspRule, SecretRule, TextRule
from .owasp_rules import OWASP_CHECKS, OWASP_RULES
from .secret_rules import SECRET_RULES

__all__ = ["CODE_RULES", "CodeRule", "OWASP_CHECKS", "OWASP_RULES", "OwaspCheck",
           "OwaspRule", "SECRET_RULES", "SecretRule", "TextRule", "rules_from_table"]
