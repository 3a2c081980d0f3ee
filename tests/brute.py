"""Plain-Python versions of the scanners, for small inputs."""

from __future__ import annotations

import hashlib
import math
import re

from codesieve.rules import CODE_RULES, OWASP_RULES, SECRET_RULES


def _matches(rule, text):
    flags = re.MULTILINE | (re.IGNORECASE if rule.ignore_case else 0)
    for m in re.finditer(rule.pattern, text, flags):
        yield text.count("\n", 0, m.start()) + 1, m


def code(path, language, text, rules=CODE_RULES):
    out = set()
    for rule in rules:
        if "any" in rule.languages or language in rule.languages:
            out |= {(path, rule.rule_id, line) for line, _ in _matches(rule, text)}
    return out


def owasp(path, text):
    return sorted((path, r.owasp_id, f"Line {line}: {r.finding_text}") for r in OWASP_RULES for line, _ in _matches(r, text))


def entropy(value):
    return -sum(p * math.log2(p) for p in (value.count(c) / len(value) for c in set(value)))


def secrets(path, text):
    out = set()
    for rule in SECRET_RULES:
        for line, m in _matches(rule, text):
            value = m.group(rule.value_group)
            if entropy(value) >= rule.min_entropy:
                out.add((path, rule.secret_type, line, mask(value)))
    return out


def mask(value):
    return "*" * len(value) if len(value) <= 4 else "*" * (len(value) - 4) + value[-4:]


def snippet(text, line):
    lines = text.splitlines()
    return "\n".join(lines[max(0, line - 3):min(len(lines), line + 2)])


def finding_id(rule, path, line):
    return f"vuln-{rule}-{hashlib.sha1((path + str(line)).encode()).hexdigest()[:8]}"
