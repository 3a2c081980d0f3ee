"""DuckDB SQL fragments that the oracle statements are put together from."""

from __future__ import annotations

from ..functions.severity import LABELS, RISK_WEIGHT
from ..functions.versions import _WORD_RANK
from ..rules import CODE_RULES, OWASP_CHECKS, OWASP_RULES, SECRET_RULES
from .inputs import quote

# RE2 has no lookaround.  These forms match at the same places as long as two
# matches do not touch; the two marked "line" test the rest of the line instead.
_RE2 = {
    "xss-001": r"""\.innerHTML\s*=(?:[^"']|["'][^<]|["']\z|\z)""",
    "A03:2021#4": r"""\.innerHTML\s*=(?:[^"']|["'][^<]|["']\z|\z)""",
    "deser-002": r"""yaml\.load\s*\([^)]*Loader\s*=\s*yaml\.(?:Loader|UnsafeLoader)|yaml\.load\s*\((?:[^)]*[^\w)])?None""",
    "A07:2021#4": r"""brute.?force|rate.?limit(?:\s*\z|\s*[^\s=]|\s*=\s*[^\s\d]|\s*=\s*\z)""",
}
_LINE_RULES = {
    "A01:2021#1": (r"""@app\.route.*methods.*(?:'GET'|"GET")(.*)""", r"login_required|@require_"),
    "A07:2021#2": (r"""session\.permanent\s*=\s*(True.*)""", r"\blifetime\b"),
}


def re2(rule) -> str:
    return ("(?im)" if rule.ignore_case else "(?m)") + _RE2.get(rule.rule_id, rule.pattern)


def hits(rule, source: str = "files") -> str:
    """(scan_id, file_path, line_number, marked line) of a rule's matches."""
    keys = "scan_id, file_path"
    langs = "" if "any" in rule.languages else \
        f" AND language IN ({', '.join(quote(x) for x in rule.languages)})"
    if rule.rule_id in _LINE_RULES:
        pattern, unless = _LINE_RULES[rule.rule_id]
        rest = f"regexp_extract(piece, {quote('(?i)' + pattern)}, 1)"
        return (f"SELECT {keys}, CAST(line AS INT) AS line_number, chr(1) AS piece FROM {source}, "
                f"unnest(string_split(code, chr(10))) WITH ORDINALITY AS u(piece, line) "
                f"WHERE regexp_matches(piece, {quote('(?i)' + pattern)}) AND NOT regexp_matches({rest}, {quote('(?i)' + unless)})")
    mark = "chr(1) || '\\1' || chr(2) || '\\0'" if rule.value_group else "chr(1) || '\\0'"
    p = quote(re2(rule))
    return (f"SELECT {keys}, CAST(line AS INT) AS line_number, piece FROM (SELECT * FROM {source} "
            f"WHERE regexp_matches(code, {p}){langs}), "
            f"unnest(string_split(regexp_replace(code, {p}, {mark}, 'g'), chr(10))) WITH ORDINALITY AS u(piece, line) "
            f"WHERE contains(piece, chr(1))")


def code_hits(source: str = "files") -> str:
    return " UNION ALL ".join(
        f"SELECT *, {quote(r.rule_id)} AS rule_id, {i} AS rule_order, {quote(r.severity)} AS severity FROM ({hits(r, source)})"
        for i, r in enumerate(CODE_RULES))


def code_rule_values(*names: str) -> str:
    rows = ", ".join(
        "(" + ", ".join([quote(r.rule_id)] + [quote(getattr(r, n)) for n in names]) + ")" for r in CODE_RULES)
    return f"(VALUES {rows}) AS rules(rule_id, {', '.join(names)})"


def owasp_hits(source: str = "files") -> str:
    severity = {c.owasp_id: c.severity for c in OWASP_CHECKS}
    return " UNION ALL ".join(
        f"SELECT *, {quote(r.owasp_id)} AS owasp_id, {r.pattern_no} AS pattern_no, {quote(r.finding_text)} AS finding_text, "
        f"{quote(severity[r.owasp_id])} AS severity, "
        f"length(piece) - length(replace(piece, chr(1), '')) AS n_hits FROM ({hits(r, source)})" for r in OWASP_RULES)


def entropy(value: str) -> str:
    return (f"list_sum(list_transform(list_distinct(string_split({value}, '')), lambda c: "
            f"-((length({value}) - length(replace({value}, c, ''))) / CAST(length({value}) AS DOUBLE)) * "
            f"log2((length({value}) - length(replace({value}, c, ''))) / CAST(length({value}) AS DOUBLE))))")


def secret_hits(source: str = "files", rules=SECRET_RULES) -> str:
    """Distinct values per (file, rule, line) that reach the rule's entropy."""
    parts = []
    for r in rules:
        values = "list_transform(string_split(piece, chr(1))[2:], lambda x: string_split(x, chr(2))[1])"
        body = (f"SELECT scan_id, file_path, line_number, {quote(r.rule_id)} AS rule_id, {quote(r.secret_type)} AS type, "
                f"{quote(r.description)} AS description, {quote(r.severity)} AS severity, CAST({r.confidence} AS DOUBLE) AS confidence, "
                f"unnest(list_distinct({values})) AS value FROM ({hits(r, source)})")
        parts.append(f"SELECT * FROM ({body}) WHERE {entropy('value')} >= {r.min_entropy}" if r.min_entropy else body)
    return " UNION ALL ".join(parts)


def mask_tail(v: str) -> str:
    return (f"CASE WHEN length({v}) <= 4 THEN repeat('*', length({v})) "
            f"ELSE repeat('*', length({v}) - 4) || right({v}, 4) END")


def finding_id(rule: str = "rule_id") -> str:
    return f"'vuln-' || {rule} || '-' || substr(sha1(file_path || CAST(line_number AS VARCHAR)), 1, 8)"


def cvss(score: str) -> str:
    return f"CASE WHEN {score} >= 9 THEN 'critical' WHEN {score} >= 7 THEN 'high' WHEN {score} >= 4 THEN 'medium' ELSE 'low' END"


def label(text: str) -> str:
    cases = " ".join(f"WHEN {quote(k)} THEN {quote(v)}" for k, v in LABELS.items())
    return f"CASE upper({text}) {cases} ELSE 'medium' END"


def weight(severity: str) -> str:
    cases = " ".join(f"WHEN {quote(k)} THEN {v}" for k, v in RISK_WEIGHT.items())
    return f"CASE {severity} {cases} ELSE 0 END"


_NUM = r"'^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$'"


def first_score(record: str = "record") -> str:
    head = "trim(split_part(s, '/', 1))"
    return (f"list_filter(list_transform(json_extract_string({record}, '$.severity[*].score'), lambda s: "
            f"CASE WHEN regexp_matches({head}, {_NUM}) THEN CAST({head} AS DOUBLE) END), lambda x: x IS NOT NULL)[1]")


def _stated(record: str, path: str) -> str:
    def one(field: str) -> str:
        text = f"json_extract_string({record}, '{path}.{field}')"
        kind = f"json_type({record}, '{path}.{field}')"
        return (f"CASE WHEN {kind} = 'VARCHAR' THEN CASE WHEN {text} <> '' THEN {label(text)} END "
                f"WHEN {kind} IN ('DOUBLE', 'UBIGINT', 'BIGINT') AND CAST({text} AS DOUBLE) <> 0 THEN {cvss(f'CAST({text} AS DOUBLE)')} END")
    return f"coalesce({one('severity')}, {one('cvss_score')})"


def advisory_severity(record: str = "record") -> str:
    score = first_score(record)
    return (f"coalesce(CASE WHEN {score} IS NOT NULL THEN {cvss(score)} END, {_stated(record, '$.database_specific')}, "
            f"{_stated(record, '$.affected[0].database_specific')}, 'medium')")


def cve_label(record: str = "record") -> str:
    score = first_score(record)
    return (f"coalesce(CASE WHEN {score} IS NOT NULL THEN upper({cvss(score)}) END, "
            f"upper(json_extract_string({record}, '$.database_specific.severity')), 'UNKNOWN')")


def cve_id(record: str = "record") -> str:
    aliases = f"list_filter(json_extract_string({record}, '$.aliases[*]'), lambda a: starts_with(a, 'CVE-'))"
    return f"coalesce({aliases}[1], json_extract_string({record}, '$.id'), 'UNKNOWN')"


def urls(record: str = "record") -> str:
    return f"list_filter(json_extract_string({record}, '$.references[*].url'), lambda u: u <> '')"


def affected(record: str = "record") -> str:
    """Names of affected packages, one JSON object at a time."""
    return (f"list_transform(list_filter(json_extract({record}, '$.affected[*].package'), lambda p: coalesce(p->>'name', '') <> ''), "
            "lambda p: CASE WHEN coalesce(p->>'ecosystem', '') = '' THEN p->>'name' ELSE (p->>'ecosystem') || '/' || (p->>'name') END)")


def version_key(v: str) -> str:
    plain = f"regexp_replace(lower(split_part(trim({v}), '+', 1)), '^v', '')"
    core = f"regexp_replace({plain}, '\\.0[.0]*($|[-_.]?[a-z]|[^0-9.])', '\\1', 'g')"
    words = "CASE p " + " ".join(f"WHEN {quote(k)} THEN {quote(r)}" for k, r in _WORD_RANK.items()) + " ELSE 'A4' || p END"
    digits = "regexp_replace(p, '^0+([0-9])', '\\1')"
    part = (f"CASE WHEN regexp_matches(p, '^[0-9]') THEN 'N' || lpad(CAST(length({digits}) AS VARCHAR), 3, '0') || {digits} "
            f"ELSE {words} END")
    return (f"CASE WHEN regexp_matches({plain}, '^[0-9]') THEN "
            f"array_to_string(list_transform(regexp_extract_all({core}, '([0-9]+|[a-z]+)', 1), lambda p: {part}), ' ') || ' E' END")


def name_key(ecosystem: str, name: str) -> str:
    return f"CASE WHEN lower({ecosystem}) = 'pypi' THEN regexp_replace(lower({name}), '[-_.]+', '-', 'g') ELSE {name} END"


def matches_ctes(deps: str = "deps") -> str:
    """CTEs ``keyed`` (dependencies with keys) and ``matches`` (package, vulnerability).

    The version test is stated from the known shape of each derived advisory
    and not by walking its JSON.
    """
    k = "k.key"
    at = lambda v: version_key(quote(v))
    upto = lambda prefix, suffix="": version_key(f"({quote(prefix)} || CAST(p % 10 AS VARCHAR) || {quote(suffix)})")
    return f"""keyed AS (SELECT scan_id, ordinal, name, coalesce(version, '') AS version, coalesce(ecosystem, 'PyPI') AS ecosystem,
    {name_key("coalesce(ecosystem, 'PyPI')", "name")} AS name_key FROM {deps}),
keys AS (SELECT DISTINCT ecosystem, name_key, version, {version_key("version")} AS key FROM keyed),
vulns AS (SELECT p, 'pkg-' || CAST(p // 2 AS VARCHAR) AS pkg, CASE WHEN (p // 2) % 2 = 0 THEN 'PyPI' ELSE 'npm' END AS eco,
    json_extract_string(record, '$.id') AS advisory_id, {cve_id()} AS cve_id,
    coalesce(json_extract_string(record, '$.summary'), 'No summary available') AS summary,
    {advisory_severity()} AS severity, json_extract_string(record, '$.published') AS published,
    {urls()}[1:5] AS refs, {upto("1.")} AS fixed_a, {upto("2.", ".0")} AS fixed_b FROM osv),
matches AS (SELECT k.ecosystem, k.name_key, k.version, vulns.* FROM keys k JOIN vulns ON lower(k.ecosystem) = lower(eco) AND k.name_key = pkg
  WHERE k.version = '' OR CASE p % 4
    WHEN 0 THEN {k} < fixed_a
    WHEN 1 THEN ({k} >= {at("1.2")} AND {k} < fixed_b) OR ({k} >= {at("3.0")} AND {k} <= {at("3.5.1")})
    WHEN 2 THEN k.version IN ('1.' || CAST(p % 10 AS VARCHAR) || '.1', '2.3.2', '0.5.4')
    ELSE FALSE END),
scored AS (SELECT ecosystem, name_key, version, count(*) AS n_vulns,
    least(10.0, avg({weight("severity")})) AS risk_score FROM matches GROUP BY ALL),
risk AS (SELECT scan_id, ordinal, name, keyed.version, keyed.ecosystem, coalesce(n_vulns, 0) AS n_vulns,
    CAST(coalesce(risk_score, 0) AS DOUBLE) AS risk_score
  FROM keyed LEFT JOIN scored ON keyed.ecosystem = scored.ecosystem AND keyed.name_key = scored.name_key AND keyed.version = scored.version)"""


def escape(v: str) -> str:
    for char, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        v = f"replace({v}, {quote(char)}, {quote(entity)})"
    return v
