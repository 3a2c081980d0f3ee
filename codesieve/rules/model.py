"""Rules are plain data: a regular expression plus what a finding reports."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class TextRule:
    """One pattern to look for in a text.

    ``requires`` is a cheap pre-test in conjunctive form: a match must contain,
    for every inner tuple, at least one of its lower-case literals.  It never
    decides a match on its own; it only spares the regular expression on texts
    that cannot match.  An empty tuple switches the pre-test off.

    ``ends`` has, for each ``.*`` of the pattern in turn, what a search by it may start
    after, and what ends it on a line (rather too much than too little); see
    ``operators.matching``.  A third entry says that the end must not come (a negative look-ahead).  It changes no match.

    ``value_group`` names the capture group that holds the reported value, for
    rules that report one (secrets).
    """

    rule_id: str
    pattern: str
    requires: tuple[tuple[str, ...], ...] = ()
    languages: tuple[str, ...] = ("any",)
    ignore_case: bool = True
    ends: tuple[tuple[str, ...], ...] = ()
    value_group: int = 0


@dataclass(frozen=True)
class CodeRule(TextRule):
    title: str = ""
    severity: str = "medium"
    category: str = ""
    description: str = ""
    remediation: str = ""
    cwe_id: str | None = None
    owasp_category: str | None = None


@dataclass(frozen=True)
class OwaspRule(TextRule):
    """One pattern of an OWASP check; ``rule_id`` is ``<owasp_id>#<pattern_no>``."""

    owasp_id: str = ""
    pattern_no: int = 0
    finding_text: str = ""


@dataclass(frozen=True)
class OwaspCheck:
    owasp_id: str
    category: str
    severity: str
    description: str


@dataclass(frozen=True)
class SecretRule(TextRule):
    secret_type: str = ""
    description: str = ""
    severity: str = "critical"
    confidence: float = 1.0
    min_entropy: float = 0.0
