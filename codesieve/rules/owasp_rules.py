"""OWASP Top 10 (2021) checks: ten checks, each with a few patterns."""

from __future__ import annotations

from .model import OwaspCheck, OwaspRule

# Check ids, categories, severities and texts.
OWASP_CHECKS: tuple[OwaspCheck, ...] = (
    OwaspCheck("A01:2021", "Broken Access Control", "critical",
               "Checks for missing authorization, IDOR patterns, and directory traversal."),
    OwaspCheck("A02:2021", "Cryptographic Failures", "high",
               "Checks for weak algorithms, hardcoded keys, and unencrypted sensitive data."),
    OwaspCheck("A03:2021", "Injection", "critical",
               "Detects SQL injection, command injection, XSS, and template injection patterns."),
    OwaspCheck("A04:2021", "Insecure Design", "medium",
               "Checks for missing rate limiting, insecure defaults, and weak validation."),
    OwaspCheck("A05:2021", "Security Misconfiguration", "high",
               "Detects insecure default configurations, verbose error messages, and open permissions."),
    OwaspCheck("A06:2021", "Vulnerable and Outdated Components", "high",
               "Checks for known unsafe library calls and outdated patterns."),
    OwaspCheck("A07:2021", "Identification and Authentication Failures", "high",
               "Detects weak authentication implementations and session management issues."),
    OwaspCheck("A08:2021", "Software and Data Integrity Failures", "high",
               "Checks for insecure deserialization and missing integrity verification."),
    OwaspCheck("A09:2021", "Security Logging and Monitoring Failures", "medium",
               "Checks for missing security event logging."),
    OwaspCheck("A10:2021", "Server-Side Request Forgery (SSRF)", "high",
               "Detects server-side HTTP requests built from user-controlled input."),
)

# Fixed values: (check id, pattern, finding text) in report order.  The last
# column is this library's own pre-test (see TextRule.requires).
_PATTERNS: tuple[tuple[str, str, str, tuple[tuple[str, ...], ...]], ...] = (
    ("A01:2021", r"""(?i)@app\.route.*methods.*(?:'GET'|"GET")(?!.*login_required|.*@require_)""",
     "Route handler lacks authentication decorator", (("@app.route",), ("methods",))),
    ("A01:2021", r"""\.objects\.get\(\s*(?:id|pk)\s*=\s*request""",
     "Direct object reference using user-supplied ID without owner check", ((".objects.get(",),)),
    ("A01:2021", r"""(?:\.\./|\.\.\\)""",
     "Path traversal sequence '../' detected", (("../", "..\\"),)),
    ("A01:2021", r"""allow_origins\s*=\s*\[?\s*['"]\*['"]\s*\]?""",
     "CORS configured with wildcard origin (*)", (("allow_origins",),)),

    ("A02:2021", r"""hashlib\.(?:md5|sha1)\b""",
     "Weak hash algorithm MD5/SHA-1 in use", (("hashlib.",),)),
    ("A02:2021", r"""(?i)(?:secret_key|encryption_key)\s*=\s*["'][^"']{1,32}["']""",
     "Hardcoded cryptographic key detected", (("secret_key", "encryption_key"),)),
    ("A02:2021", r"""verify\s*=\s*False""",
     "SSL/TLS certificate verification disabled", (("verify",), ("false",))),
    ("A02:2021", r"""\brandom\.(?:random|randint)\b""",
     "Non-cryptographic random used in security context", (("random.rand",),)),

    ("A03:2021", r"""(?:execute|query|raw)\s*\(\s*(?:f['""]|['""].*\+)""",
     "SQL query built with string concatenation", (("execute", "query", "raw"), ("(",), ('"', "'")),
     (("execute|query|raw", r"\+"),)),
    ("A03:2021", r"""subprocess\.[a-z_]+\s*\(.*shell\s*=\s*True""",
     "Subprocess call with shell=True enables command injection", (("subprocess.",), ("shell",)),
     ((r"subprocess\.", r"shell\s*(?:=\s*(?:True|$)|$)"),)),
    ("A03:2021", r"""\beval\s*\(""",
     "eval() usage — code injection risk", (("eval",), ("(",))),
    ("A03:2021", r"""\.innerHTML\s*=\s*(?!["']<)""",
     "innerHTML assignment — XSS risk", ((".innerhtml",),)),
    ("A03:2021", r"""pickle\.loads?\s*\(""",
     "Pickle deserialization — code execution risk", (("pickle.load",),)),
    ("A03:2021", r"""yaml\.load\s*\(""",
     "yaml.load without SafeLoader — code execution risk", (("yaml.load",),)),

    ("A04:2021", r"""(?i)debug\s*=\s*True""",
     "Debug mode enabled in production code", (("debug",), ("true",))),
    ("A04:2021", r"""(?i)secret_key\s*=\s*["'](?:secret|changeme|dev|test|dummy)["']""",
     "Weak/default secret key in use", (("secret_key",),)),
    ("A04:2021", r"""(?i)allow_all|permit_all|no_auth""",
     "Permissive authorization pattern detected", (("allow_all", "permit_all", "no_auth"),)),

    ("A05:2021", r"""(?i)SHOW_ERRORS\s*=\s*True|DEBUG\s*=\s*True""",
     "Verbose error messages enabled", (("show_errors", "debug"), ("true",))),
    ("A05:2021", r"""(?i)(?:S3|Bucket|Container).*public|ACL\s*=\s*['"]public""",
     "Cloud storage configured as public", (("s3", "bucket", "container", "acl"), ("public",)),
     (("S3|Bucket|Container", "public"),)),
    ("A05:2021", r"""chmod\s*\(\s*['""]?0?777['"]?""",
     "File permissions set to world-writable (777)", (("chmod",), ("777",))),
    ("A05:2021", r"""(?i)default_permissions\s*=\s*["'](?:allow|all)["']""",
     "Default-allow permission policy detected", (("default_permissions",),)),

    ("A06:2021", r"""\b(?:strcpy|strcat|gets|sprintf)\s*\(""",
     "Unsafe C string function without bounds checking", (("strcpy", "strcat", "gets", "sprintf"), ("(",))),
    ("A06:2021", r"""import\s+(?:urllib2|httplib|cookielib)""",
     "Python 2 deprecated module import", (("import",), ("urllib2", "httplib", "cookielib"))),

    ("A07:2021", r"""(?i)password\s*==\s*["'][^"']{1,20}["']""",
     "Hardcoded password comparison", (("password",), ("==",))),
    ("A07:2021", r"""(?i)session\.permanent\s*=\s*True(?!.*\blifetime\b)""",
     "Permanent session without explicit timeout", (("session.permanent",),),
     ((r"session\.permanent", r"\blifetime\b", "absent"),)),
    ("A07:2021", r"""(?i)(?:min_length|min_password_length)\s*=\s*[0-7]\b""",
     "Weak minimum password length (< 8 characters)", (("min_length", "min_password_length"),)),
    ("A07:2021", r"""(?i)brute.?force|rate.?limit(?!\s*=\s*\d)""",
     "Missing rate limiting for authentication endpoint", (("brute", "rate"), ("force", "limit"))),

    ("A08:2021", r"""pickle\.(?:load|loads|Unpickler)""",
     "Unsafe pickle deserialization", (("pickle.",),)),
    ("A08:2021", r"""(?i)integrity\s*=\s*["']?(?:none|false|0)["']?""",
     "Integrity checking explicitly disabled", (("integrity",), ("=",))),
    ("A08:2021", r"""(?i)(?:from|import)\s+.*?(?:untrusted|unsafe)""",
     "Import from untrusted source", (("from", "import"), ("untrusted", "unsafe")),
     (("from|import", "untrusted|unsafe"),)),

    ("A09:2021", r"""except\s+(?:Exception|BaseException)?\s*(?:as\s+\w+)?\s*:\s*\n\s*pass""",
     "Exception silently swallowed — security events may be lost", (("except",), ("pass",))),
    ("A09:2021", r"""logging\.disable\s*\(\s*logging\.CRITICAL\s*\)""",
     "All logging disabled programmatically", (("logging.disable",),)),

    ("A10:2021", r"""requests\.\w+\s*\(\s*(?:url\s*=\s*)?(?:request|req|user_url|target_url)""",
     "HTTP request URL derived from user input — potential SSRF", (("requests.",), ("(",))),
    ("A10:2021", r"""urllib\.request\.urlopen\s*\(\s*(?:request|req|user|input)""",
     "urlopen with user-controlled URL — potential SSRF", (("urllib.request.urlopen",),)),
)


def _number(rows) -> tuple[OwaspRule, ...]:
    numbered, seen = [], {}
    for owasp_id, pattern, text, requires, *ends in rows:
        seen[owasp_id] = seen.get(owasp_id, 0) + 1
        numbered.append(OwaspRule(
            rule_id=f"{owasp_id}#{seen[owasp_id]}",
            pattern=pattern,
            requires=requires,
            ends=ends[0] if ends else (),
            owasp_id=owasp_id,
            pattern_no=seen[owasp_id],
            finding_text=text,
        ))
    return tuple(numbered)


OWASP_RULES: tuple[OwaspRule, ...] = _number(_PATTERNS)
