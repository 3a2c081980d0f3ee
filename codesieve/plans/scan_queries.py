"""Queries over source texts: code rules, OWASP checks, secrets."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.severity import severity_color, severity_normalise
from ..functions.text import line_number, mask_middle, mask_tail, sha1_short
from ..operators import findings as fnd
from ..operators import summaries
from ..operators.code_scan import code_request, code_scan, deduplicate, rule_apply, rules_for_language, static_review
from ..operators.owasp import owasp_scan, owasp_status, owasp_totals
from ..operators.rule_index import scan_with_table
from ..operators.secrets import entropy_candidates, patch_path, secret_scan, secret_union, secrets_request, uncovered
from ..rules import CODE_RULES, OWASP_CHECKS, SECRET_RULES, rules_from_table
from ..session import shared_folder
from ..sinks.ranges import write_parts
from ..sources.files import SUFFIXES, decode_files, flag_oversize, language_of, scan_directory, submitted_code
from ..sources.scanner_reports import parse_bearer, parse_gitleaks, parse_trufflehog
from . import inputs, sql
from .inputs import quote, with_inputs
from .registry import query

_KEY = "scan_id, file_path, rule_id, line_number"
_CODE = f"(SELECT DISTINCT {_KEY}, rule_order, severity FROM ({sql.code_hits()}))"
_LEVEL_COUNTS = ", ".join(
    f"count(*) FILTER (WHERE severity = '{s}') AS {s}" for s in ("critical", "high", "medium", "low", "info"))


# --- sources ---------------------------------------------------------------------

@query("src_code", with_inputs("submissions", query="""
SELECT scan_id, coalesce(nullif(file_path, ''), '<stdin.' || lower(coalesce(language, 'python')) || '>') AS file_path,
  lower(coalesce(language, 'python')) AS language, CAST(length(code) AS INT) AS n_chars, 'code' AS step FROM submissions UNION ALL
SELECT scan_id, coalesce(nullif(file_path, ''), '<stdin>'), lower(coalesce(language, 'python')), CAST(length(code) AS INT), 'secrets' FROM submissions"""))
def src_code(spark, sf_dir):
    requests = inputs.submissions(spark, sf_dir)
    code = submitted_code(requests).withColumn("step", F.lit("code"))
    secrets = submitted_code(requests, for_secrets=True).withColumn("step", F.lit("secrets"))
    return code.unionByName(secrets).select("scan_id", "file_path", "language", F.length("code").alias("n_chars"), "step")


@query("src_directory", """
SELECT 'src/' || CAST(doc_id AS VARCHAR) || '.py' AS file_path, 'python' AS language,
  CAST(length(text) + 3 AS INT) AS n_chars, sha1(text || 'end') AS code_sha1 FROM documents""")
def src_directory(spark, sf_dir):
    """Texts with invalid bytes put in; decoding has to drop exactly those."""
    docs = inputs.table(spark, sf_dir, "documents", "doc_id", "text")
    broken = docs.select(
        F.concat(F.lit("src/"), F.col("doc_id").cast("string"), F.lit(".py")).alias("path"),
        F.concat(F.unhex(F.lit("FFFE")), F.col("text").cast("binary"), F.unhex(F.lit("80C3")),
                 F.lit("end").cast("binary"), F.unhex(F.lit("E282"))).alias("content"))
    return decode_files(broken).select(
        "file_path", "language", F.length("code").alias("n_chars"), F.sha1("code").alias("code_sha1"))


@query("src_language", with_inputs("files", query="""
SELECT file_path, CASE regexp_extract(file_path, '(\\.[^./]+)$', 1) """
       + " ".join(f"WHEN {quote(k)} THEN {quote(v)}" for k, v in SUFFIXES.items()) + " END AS language FROM files"))
def src_language(spark, sf_dir):
    return inputs.files(spark, sf_dir).select("file_path", language_of(F.col("file_path")).alias("language"))


@query("src_size_cap", """
SELECT strlen(text) <= 8000 AS within_cap, count(*) AS n_files, CAST(sum(strlen(text)) AS BIGINT) AS n_bytes
FROM documents GROUP BY ALL""")
def src_size_cap(spark, sf_dir):
    flagged = flag_oversize(inputs.table(spark, sf_dir, "documents", "text"), size_cap=8000, text="text")
    return flagged.groupBy("within_cap").agg(F.count("*").alias("n_files"), F.sum("n_bytes").alias("n_bytes"))


_GITLEAKS = f"""
SELECT scan_id, file_path, 'gl-' || coalesce(f->>'Fingerprint', substr(coalesce(f->>'Match', ''), 1, 16)) AS id,
  coalesce(f->>'RuleID', 'unknown') AS type,
  coalesce(f->>'Description', f->>'RuleID', 'Secret detected by gitleaks') AS description,
  {sql.mask_tail("coalesce(f->>'Secret', '')")} AS masked_value, f->>'File' AS reported_path,
  CAST(f->>'StartLine' AS INT) AS line_number, 'critical' AS severity, CAST(0.95 AS DOUBLE) AS confidence
FROM (SELECT scan_id, file_path, unnest(CASE WHEN NOT json_valid(report) THEN [] WHEN json_type(report) = 'ARRAY'
  THEN json_extract(report, '$[*]') ELSE [CAST(report AS JSON)] END) AS f FROM gitleaks)"""


@query("src_gitleaks", with_inputs("gitleaks", query=_GITLEAKS))
def src_gitleaks(spark, sf_dir):
    return parse_gitleaks(inputs.gitleaks(spark, sf_dir))


_TRUFFLEHOG = f"""
SELECT scan_id, file_path, 'th-' || coalesce(f->'StructuredData'->>'id', nullif(substr(raw, 1, 16), ''), 'unknown') AS id,
  coalesce(f->>'DetectorName', 'Unknown') AS type,
  'TruffleHog detected: ' || coalesce(f->>'DetectorName', 'Unknown') AS description,
  CASE WHEN raw = '' THEN '****' ELSE {sql.mask_tail("raw")} END AS masked_value,
  coalesce(nullif(fs->>'file', ''), nullif(git->>'file', '')) AS reported_path,
  coalesce(nullif(CAST(fs->>'line' AS INT), 0), nullif(CAST(git->>'lineNumber' AS INT), 0)) AS line_number,
  'critical' AS severity, CAST(CASE WHEN f->>'Verified' = 'true' THEN 1 ELSE 0 END AS DOUBLE) AS confidence
FROM (SELECT *, coalesce(f->>'Raw', f->>'RawV2', '') AS raw, f->'SourceMetadata'->'Data'->'Filesystem' AS fs,
    f->'SourceMetadata'->'Data'->'Git' AS git
  FROM (SELECT scan_id, file_path, CAST(line AS JSON) AS f
    FROM (SELECT scan_id, file_path, unnest(string_split(report, chr(10))) AS line FROM trufflehog)
    WHERE trim(line) <> '' AND json_valid(line)))"""


@query("src_trufflehog", with_inputs("trufflehog", query=_TRUFFLEHOG))
def src_trufflehog(spark, sf_dir):
    return parse_trufflehog(inputs.trufflehog(spark, sf_dir))


_BEARER = """
SELECT scan_id, file_path, 'bearer-' || coalesce(f->>'id', f->>'rule_id', 'unknown') AS id,
  coalesce(f->>'title', f->>'rule_id', 'Bearer finding') AS title, coalesce(f->>'description', '') AS description,
  CASE lower(k) WHEN 'critical' THEN 'critical' WHEN 'high' THEN 'high' WHEN 'medium' THEN 'medium'
    WHEN 'low' THEN 'low' WHEN 'warning' THEN 'low' ELSE 'medium' END AS severity,
  coalesce(f->>'category', 'SAST') AS category, f->>'filename' AS reported_path,
  coalesce(nullif(CAST(f->>'line_number' AS INT), 0), nullif(CAST(f->'source'->>'start' AS INT), 0)) AS line_number,
  coalesce(f->>'code_extract', '') AS code_snippet, coalesce(f->>'documentation_url', '') AS remediation,
  f->'cwe_ids'->>0 AS cwe_id, CASE WHEN json_type(f, '$.owasp') = 'OBJECT' THEN f->'owasp'->>'name' END AS owasp_category
FROM (SELECT scan_id, file_path, k, unnest(json_extract(json_extract(report, '$."' || k || '"'), '$[*]')) AS f
  FROM (SELECT scan_id, file_path, report, unnest(json_keys(report)) AS k
    FROM (SELECT * FROM bearer WHERE json_valid(report)) WHERE json_type(report) = 'OBJECT')
  WHERE json_type(report, '$."' || k || '"') = 'ARRAY')"""


@query("src_bearer", with_inputs("bearer", query=_BEARER))
def src_bearer(spark, sf_dir):
    return parse_bearer(inputs.bearer(spark, sf_dir))


# --- requests --------------------------------------------------------------------

_STEPS = """(SELECT *, unnest(list_filter(['secrets', 'code', 'owasp'],
  lambda s: list_contains(coalesce(scan_types, ['secrets', 'code', 'owasp']), s))) AS step FROM submissions)"""


@query("scan_type_select", with_inputs("submissions", query=f"SELECT scan_id, doc_id, step FROM {_STEPS}"))
def scan_type_select(spark, sf_dir):
    return fnd.select_scan_types(inputs.submissions(spark, sf_dir)).select("scan_id", "doc_id", "step")


@query("input_rejects", with_inputs("submissions", query=f"""
SELECT scan_id, doc_id, step, CASE WHEN step = 'secrets' THEN 'Provide ''code'' or ''file_path''' ELSE 'Provide ''code'' field' END AS reason
FROM {_STEPS} WHERE coalesce(code, '') = '' AND (step <> 'secrets' OR coalesce(file_path, '') = '')"""))
def input_rejects(spark, sf_dir):
    steps = fnd.select_scan_types(inputs.submissions(spark, sf_dir))
    return fnd.split_inputs(steps).where("reason is not null").select("scan_id", "doc_id", "step", "reason")


_BUCKET = "CASE WHEN doc_id % 3 = 0 THEN 0 ELSE doc_id % 200 END"
_FILE_CAP = 60_000


@query("src_directory_files", f"""
SELECT bucket, n_bytes, status, reason, language, code_hash FROM (
  SELECT bucket, CAST(strlen(code) AS BIGINT) AS n_bytes, 'text' AS language,
    CASE WHEN strlen(code) <= {_FILE_CAP} THEN 'text' ELSE 'oversize' END AS status,
    CASE WHEN strlen(code) > {_FILE_CAP} THEN 'larger than {_FILE_CAP} bytes' END AS reason, CASE WHEN strlen(code) <= {_FILE_CAP} THEN sha256(code) END AS code_hash
  FROM (SELECT CAST({_BUCKET} AS INT) AS bucket, string_agg(coalesce(text, '') || chr(10), '' ORDER BY doc_id) AS code FROM documents GROUP BY 1))""")
def src_directory_files(spark, sf_dir):
    """Real files of mixed sizes, written from the documents: listed, read or rejected.  A third of the documents are one file, so files are in parts."""
    folder = shared_folder(spark, "directory")
    docs = inputs.table(spark, sf_dir, "documents", "doc_id", "text").withColumn("bucket", F.expr(_BUCKET).cast("int"))
    write_parts(docs.select("bucket", "doc_id", F.coalesce("text", F.lit("")).alias("value")), folder, "value", "bucket", ["doc_id"])
    found = scan_directory(spark, folder, _FILE_CAP, in_parts=True).where(F.col("file_path").rlike("/bucket=[0-9]+$"))
    return found.select(F.regexp_extract("file_path", "/bucket=([0-9]+)$", 1).cast("int").alias("bucket"), "n_bytes", "status", "reason", "language",
                        F.sha2(F.col("code").cast("binary"), 256).alias("code_hash"))


# --- code rules --------------------------------------------------------------------

@query("rule_language_filter", with_inputs("files", query="SELECT language, count(*) AS n_files, CASE language "
       + " ".join(f"WHEN {quote(lang)} THEN " + quote(",".join(
           r.rule_id for r in CODE_RULES if "any" in r.languages or lang in r.languages)) for lang in inputs.LANGUAGES)
       + " END AS rules FROM files GROUP BY ALL"))
def rule_language_filter(spark, sf_dir):
    languages = inputs.files(spark, sf_dir).groupBy("language").agg(F.count("*").alias("n_files"))
    return languages.select("language", "n_files", F.array_join(rules_for_language(F.col("language")), ",").alias("rules"))


@query("rule_apply", with_inputs("files", query=f"SELECT DISTINCT scan_id, file_path, rule_id FROM {_CODE}"))
def rule_apply_query(spark, sf_dir):
    return rule_apply(inputs.files(spark, sf_dir))


@query("code_scan", with_inputs("files", query=f"""
SELECT scan_id, file_path, rule_id, rule_order, line_number, severity, title, category, cwe_id, owasp_category,
  {sql.finding_id()} AS finding_id
FROM {_CODE} JOIN {sql.code_rule_values('title', 'category', 'cwe_id', 'owasp_category')} USING (rule_id)"""))
def code_scan_query(spark, sf_dir):
    found = code_scan(inputs.files(spark, sf_dir), with_snippet=False)
    return found.select("scan_id", "file_path", "rule_id", "rule_order", "line_number", "severity", "title", "category",
                        "cwe_id", "owasp_category", "finding_id")


_SNIPPET = """array_to_string(list_slice(lines, greatest(line_number - 2, 1), least(line_number + 2, len(lines))), chr(10))"""
_LINES = "CASE WHEN p[-1] = '' THEN p[1:-2] ELSE p END"


@query("code_snippet", with_inputs("files", query=f"""
SELECT {_KEY}, {_SNIPPET} AS code_snippet FROM {_CODE}
JOIN (SELECT file_path, {_LINES} AS lines FROM (SELECT file_path, string_split(code, chr(10)) AS p FROM files)) USING (file_path)"""))
def code_snippet(spark, sf_dir):
    return code_scan(inputs.files(spark, sf_dir)).select("scan_id", "file_path", "rule_id", "line_number", "code_snippet")


@query("finding_id", with_inputs("files", query=f"""
SELECT finding_id, count(*) AS n FROM (SELECT {sql.finding_id()} AS finding_id FROM {_CODE}) GROUP BY ALL"""))
def finding_id_query(spark, sf_dir):
    return code_scan(inputs.files(spark, sf_dir), with_snippet=False).groupBy("finding_id").agg(F.count("*").alias("n"))


@query("finding_dedup", with_inputs("files", "old_files", query=f"""
SELECT DISTINCT {_KEY} FROM (SELECT * FROM {_CODE} UNION ALL
  SELECT {_KEY}, rule_order, severity FROM ({sql.code_hits('old_files')}))"""))
def finding_dedup(spark, sf_dir):
    """Findings of two runs over nearly the same files."""
    runs = [code_scan(f(spark, sf_dir), with_snippet=False) for f in (inputs.files, inputs.old_files)]
    return deduplicate(runs[0].unionByName(runs[1])).select("scan_id", "file_path", "rule_id", "line_number")


@query("line_number", with_inputs("files", query="""
SELECT file_path, char_offset, CAST(length(c) - length(replace(c, chr(10), '')) + 1 AS INT) AS line_number
FROM (SELECT file_path, CAST(length(code) // 2 AS INT) AS char_offset, substr(code, 1, length(code) // 2) AS c FROM files)"""))
def line_number_query(spark, sf_dir):
    """The line of the middle of every text."""
    at = F.floor(F.length("code") / 2).cast("int")
    return inputs.files(spark, sf_dir).select("file_path", at.alias("char_offset"), line_number(F.col("code"), at).alias("line_number"))


@query("sha1_short", with_inputs("files", query="SELECT file_path, substr(sha1(code), 1, 8) AS short FROM files"))
def sha1_short_query(spark, sf_dir):
    return inputs.files(spark, sf_dir).select("file_path", sha1_short(F.col("code")).alias("short"))


@query("code_review_static", with_inputs("files", query=f"""
SELECT scan_id, file_path, count(finding_id) AS static_count,
  coalesce(string_agg(finding_id, ',' ORDER BY rule_order, line_number), '') AS static_findings
FROM files LEFT JOIN (SELECT file_path, rule_order, line_number, {sql.finding_id()} AS finding_id FROM {_CODE}) USING (file_path)
GROUP BY ALL"""))
def code_review_static(spark, sf_dir):
    review = static_review(inputs.files(spark, sf_dir))
    return review.withColumn("static_findings", F.array_join("static_findings", ","))


# --- OWASP ---------------------------------------------------------------------------

@query("owasp_scan", with_inputs("files", query=f"""
SELECT scan_id, file_path, owasp_id, pattern_no, line_number,
  'Line ' || CAST(line_number AS VARCHAR) || ': ' || finding_text AS finding, CAST(unnest(range(1, n_hits + 1)) AS INT) AS occurrence
FROM ({sql.owasp_hits()})"""))
def owasp_scan_query(spark, sf_dir):
    return owasp_scan(inputs.files(spark, sf_dir))


_CHECKS = "(VALUES " + ", ".join(
    f"({quote(c.owasp_id)}, {quote(c.category)}, {quote(c.severity)})" for c in OWASP_CHECKS) + ") AS c(owasp_id, category, severity)"


def _status_sql(unit: str) -> str:
    return f"""(SELECT {unit}, owasp_id, category, severity, CASE WHEN coalesce(n, 0) > 0 THEN 'FAIL' ELSE 'PASS' END AS status,
  CAST(coalesce(n, 0) AS BIGINT) AS n_findings
FROM (SELECT DISTINCT {unit} FROM files) CROSS JOIN {_CHECKS}
LEFT JOIN (SELECT {unit}, owasp_id, sum(n_hits) AS n FROM ({sql.owasp_hits()}) GROUP BY ALL) USING ({unit}, owasp_id))"""


@query("user_rules", with_inputs("files", "user_rules", query="""
SELECT scan_id, file_path, rule_id, CAST(line_number AS INT) AS line_number, severity, title
FROM (SELECT scan_id, file_path, language, lower(unnest(p)) AS line, unnest(range(1, len(p) + 1)) AS line_number
  FROM (SELECT *, string_split(code, chr(10)) AS p FROM files)) JOIN user_rules ON rule_language IN ('any', language)
WHERE starts_with(line, head) OR contains(line, ' ' || head) OR contains(line, '(' || head)"""))
def user_rules(spark, sf_dir):
    rules = rules_from_table(inputs.user_rules(spark, sf_dir))
    found = code_scan(inputs.files(spark, sf_dir), rules=rules, with_snippet=False)
    return found.select("scan_id", "file_path", "rule_id", "line_number", "severity", "title")


@query("user_rules_index", with_inputs("files", "rule_table", query="""
SELECT scan_id, file_path, kind, rule_id, line_number, CAST(CASE kind WHEN 'code' THEN 1 WHEN 'owasp' THEN count(*) ELSE count(DISTINCT word) END AS INT) AS n_hits
FROM (SELECT scan_id, file_path, language, CAST(line_number AS INT) AS line_number, unnest(regexp_extract_all(line, '[\\p{L}\\p{M}\\p{N}_]+')) AS word
  FROM (SELECT scan_id, file_path, language, unnest(p) AS line, unnest(range(1, len(p) + 1)) AS line_number
    FROM (SELECT *, string_split(code, chr(10)) AS p FROM files))) JOIN rule_table ON lower(left(word, 3)) = head
WHERE (NOT python_only OR language = 'python') AND (kind <> 'secrets' OR regexp_full_match(word, '[A-Za-z]{6,}'))
GROUP BY scan_id, file_path, kind, rule_id, line_number"""))
def user_rules_index(spark, sf_dir):
    """A rule for every part, by the rule index."""
    found = scan_with_table(inputs.files(spark, sf_dir), inputs.rule_table(spark, sf_dir))
    return found.select("scan_id", "file_path", "kind", "rule_id", "line_number", "n_hits")


@query("owasp_status", with_inputs("files", query=f"SELECT * FROM {_status_sql('scan_id')}"))
def owasp_status_query(spark, sf_dir):
    return owasp_status(inputs.files(spark, sf_dir))


@query("owasp_totals", with_inputs("files", query=f"""
SELECT file_path, count(*) FILTER (WHERE status = 'PASS') AS passed, count(*) FILTER (WHERE status = 'FAIL') AS failed,
  count(*) AS total FROM {_status_sql('file_path')} GROUP BY file_path"""))
def owasp_totals_query(spark, sf_dir):
    return owasp_totals(owasp_status(inputs.files(spark, sf_dir), by=["file_path"]), by=["file_path"])


# --- secrets -------------------------------------------------------------------------

_SECRET = f"""(SELECT scan_id, file_path, line_number, type, description, {sql.mask_tail('value')} AS masked_value, severity, confidence,
  'sec-' || rule_id || '-' || substr(sha1(file_path || ':' || CAST(line_number AS VARCHAR) || ':' || value), 1, 8) AS id,
  'built-in' AS scanner FROM ({sql.secret_hits()}))"""


@query("secret_scan", with_inputs("files", query=f"SELECT * FROM {_SECRET}"))
def secret_scan_query(spark, sf_dir):
    return secret_scan(inputs.files(spark, sf_dir))


_ENTROPY_RULES = [r for r in SECRET_RULES if r.min_entropy]


@query("entropy_filter", with_inputs("files", query=f"""
SELECT scan_id, file_path, line_number, {sql.mask_tail('value')} AS masked_value, CAST(length(value) AS INT) AS n_chars,
  round({sql.entropy('value')}, 6) AS entropy FROM ({sql.secret_hits(rules=_ENTROPY_RULES)})"""))
def entropy_filter(spark, sf_dir):
    found = entropy_candidates(inputs.files(spark, sf_dir)).where(F.col("entropy") >= _ENTROPY_RULES[0].min_entropy)
    return found.withColumn("entropy", F.round("entropy", 6))


_WORDS = "(SELECT unnest(string_split(replace(code, chr(10), ' '), ' ')) AS w FROM files)"


def _words(spark, sf_dir):
    """Every word of every text."""
    text = F.replace("code", F.lit("\n"), F.lit(" "))
    return inputs.files(spark, sf_dir).select(F.explode(F.split(text, " ", -1)).alias("w"))


@query("mask_tail", with_inputs("files", query=f"SELECT {sql.mask_tail('w')} AS masked, count(*) AS n FROM {_WORDS} GROUP BY ALL"))
def mask_tail_query(spark, sf_dir):
    return _words(spark, sf_dir).groupBy(mask_tail(F.col("w")).alias("masked")).agg(F.count("*").alias("n"))


@query("mask_middle", with_inputs("files", query=f"""
SELECT CASE WHEN w = '' THEN '' WHEN length(w) <= 8 THEN repeat(chr(8226), 8)
  ELSE left(w, 4) || repeat(chr(8226), least(length(w) - 8, 12)) || right(w, 4) END AS masked, count(*) AS n FROM {_WORDS} GROUP BY ALL"""))
def mask_middle_query(spark, sf_dir):
    return _words(spark, sf_dir).groupBy(mask_middle(F.col("w")).alias("masked")).agg(F.count("*").alias("n"))


_GL_PATCHED = """(SELECT scan_id, file_path, unnest(CASE WHEN shape = 0 THEN ['gl-fp-' || rest, 'gl-0123456789abcdef']
  WHEN shape = 1 THEN ['gl-ey' || substr(sha1(rest), 1, 14)] ELSE ['gl-m' || rest] END) AS id
  FROM (SELECT *, regexp_extract(file_path, '([0-9]+)', 1) AS rest FROM gitleaks WHERE shape IN (0, 1, 4)))"""


@query("secret_union", with_inputs("gitleaks", "trufflehog", query="""
SELECT 'gitleaks' AS scanner, scan_id, CAST(sum(len(CASE WHEN shape = 0 THEN [1, 2] WHEN shape IN (1, 4) THEN [1] ELSE [] END)) AS BIGINT) AS n
FROM gitleaks WHERE shape IN (0, 1, 4) GROUP BY ALL UNION ALL
SELECT 'trufflehog', scan_id, CAST(sum(CASE shape WHEN 0 THEN 2 WHEN 1 THEN 1 WHEN 3 THEN 2 ELSE 0 END) AS BIGINT) FROM trufflehog WHERE shape <> 2 GROUP BY ALL"""))
def secret_union_query(spark, sf_dir):
    tagged = [parse(read(spark, sf_dir)).withColumn("scanner", F.lit(name)) for name, parse, read in (
        ("gitleaks", parse_gitleaks, inputs.gitleaks), ("trufflehog", parse_trufflehog, inputs.trufflehog))]
    return secret_union(*tagged).groupBy("scanner", "scan_id").agg(F.count("*").alias("n"))


@query("file_path_patch", with_inputs("bearer", query="""
SELECT scan_id, CASE WHEN shape = 0 AND first THEN file_path END AS file_path, count(*) AS n
FROM (SELECT scan_id, file_path, shape, unnest(CASE WHEN shape IN (0, 3) THEN [true, false] WHEN shape = 1 THEN [true] ELSE [] END) AS first FROM bearer)
GROUP BY ALL"""))
def file_path_patch(spark, sf_dir):
    patched = patch_path(parse_bearer(inputs.bearer(spark, sf_dir)), only_if_reported=True)
    return patched.groupBy("scan_id", "file_path").agg(F.count("*").alias("n"))


@query("scanner_precedence", with_inputs("files", "gitleaks", query=f"""
SELECT scan_id, file_path, id FROM {_GL_PATCHED} UNION ALL
SELECT scan_id, file_path, id FROM {_SECRET} WHERE file_path NOT IN (SELECT file_path FROM gitleaks WHERE shape <> 3)"""))
def scanner_precedence_query(spark, sf_dir):
    """A report that is no JSON stands for a failed run."""
    reports = inputs.gitleaks(spark, sf_dir)
    external = patch_path(parse_gitleaks(reports)).select("scan_id", "file_path", "id")
    finished = reports.where(F.try_parse_json("report").isNotNull())
    built_in = secret_scan(uncovered(inputs.files(spark, sf_dir), finished)).select("scan_id", "file_path", "id")
    return external.unionByName(built_in)


@query("scan_secrets_request", with_inputs("files", "gitleaks", "trufflehog", query=f"""
SELECT * FROM {_SECRET} WHERE file_path NOT IN (SELECT file_path FROM gitleaks WHERE shape <> 3)
UNION ALL BY NAME SELECT * EXCLUDE (reported_path), 'gitleaks' AS scanner FROM ({_GITLEAKS})
UNION ALL BY NAME SELECT * EXCLUDE (reported_path), 'trufflehog' AS scanner FROM ({_TRUFFLEHOG})"""))
def scan_secrets_request(spark, sf_dir):
    """A gitleaks report that is no JSON stands for a failed run."""
    reports = inputs.gitleaks(spark, sf_dir)
    return secrets_request(inputs.files(spark, sf_dir), parse_gitleaks(reports), reports.where(F.try_parse_json("report").isNotNull()),
                           parse_trufflehog(inputs.trufflehog(spark, sf_dir)))


@query("scan_code_request", with_inputs("files", "bearer", query=f"""
SELECT scan_id, file_path, line_number, {sql.finding_id()} AS id, title, description, severity, category, remediation, cwe_id,
  owasp_category, 'built-in' AS scanner
FROM {_CODE} JOIN {sql.code_rule_values('title', 'description', 'category', 'remediation', 'cwe_id', 'owasp_category')} USING (rule_id)
WHERE file_path NOT IN (SELECT file_path FROM bearer WHERE shape <> 4)
UNION ALL BY NAME SELECT scan_id, CASE WHEN coalesce(reported_path, '') <> '' THEN file_path END AS file_path, line_number, id, title,
  description, severity, category, remediation, cwe_id, owasp_category, 'bearer' AS scanner FROM ({_BEARER})"""))
def scan_code_request(spark, sf_dir):
    """A Bearer report that is no JSON stands for a failed run; JSON that is no object, for one that found nothing."""
    reports = inputs.bearer(spark, sf_dir)
    finished = reports.where(F.try_parse_json("report").isNotNull())
    return code_request(inputs.files(spark, sf_dir), parse_bearer(reports), finished, with_snippet=False)


# --- all scanners ---------------------------------------------------------------------

_FULL = f"""(SELECT scan_id, file_path, 'code' AS kind, rule_id, severity, line_number, 1 AS occurrence FROM {_CODE}
UNION ALL SELECT scan_id, file_path, 'owasp', owasp_id || '#' || CAST(pattern_no AS VARCHAR), severity, line_number,
  CAST(unnest(range(1, n_hits + 1)) AS INT) FROM ({sql.owasp_hits()})
UNION ALL SELECT scan_id, file_path, 'secrets', rule_id, severity, line_number,
  CAST(row_number() OVER (PARTITION BY file_path, rule_id, line_number) AS INT) FROM ({sql.secret_hits()}))"""


@query("scan_full", with_inputs("files", query=f"SELECT * FROM {_FULL}"))
def scan_full_query(spark, sf_dir):
    return fnd.scan_full(inputs.files(spark, sf_dir)).drop("title")


@query("scan_full_risk", with_inputs("files", query=f"""
SELECT scan_id, count(severity) AS n_findings, CAST(least(10.0, coalesce(avg({sql.weight('severity')}), 0.0)) AS DOUBLE) AS risk_score
FROM {_FULL} GROUP BY scan_id"""))
def scan_full_risk(spark, sf_dir):
    found = fnd.scan_full(inputs.files(spark, sf_dir))
    return summaries.scan_risk(found, inputs.scans(spark, sf_dir))


# --- summaries, order, history ------------------------------------------------------------

@query("severity_summary", with_inputs("files", query=f"""
SELECT scan_id, {_LEVEL_COUNTS} FROM (SELECT DISTINCT scan_id FROM files) LEFT JOIN {_CODE} USING (scan_id) GROUP BY scan_id"""))
def severity_summary(spark, sf_dir):
    found = code_scan(inputs.files(spark, sf_dir), with_snippet=False)
    return summaries.severity_summary(found, inputs.scans(spark, sf_dir))


@query("finding_count", with_inputs("files", query=f"""
SELECT scan_id, count(rule_id) AS n_findings FROM (SELECT DISTINCT scan_id FROM files) LEFT JOIN {_CODE} USING (scan_id) GROUP BY scan_id"""))
def finding_count(spark, sf_dir):
    found = code_scan(inputs.files(spark, sf_dir), with_snippet=False)
    return summaries.finding_count(found, inputs.scans(spark, sf_dir))


@query("dashboard_stats", with_inputs("files", query=f"""
SELECT count(*) AS scans, CAST(sum(critical + high) AS BIGINT) AS critical,
  CAST(sum(CASE WHEN critical + high = 0 THEN medium ELSE 0 END) AS BIGINT) AS warnings,
  count(*) FILTER (WHERE critical + high + medium + low + info = 0) AS clean
FROM (SELECT file_path, {_LEVEL_COUNTS} FROM files LEFT JOIN {_CODE} USING (file_path) GROUP BY file_path)"""))
def dashboard_stats(spark, sf_dir):
    """Here every file counts as one scan, as it does on the dashboard."""
    files = inputs.files(spark, sf_dir)
    found = code_scan(files, with_snippet=False)
    one = lambda df: df.withColumn("scan_id", F.col("file_path"))
    return summaries.dashboard_stats(one(found), one(files).select("scan_id"))


@query("findings_top30", with_inputs("files", query=f"""
SELECT {_KEY}, position FROM (SELECT *, CAST(row_number() OVER (PARTITION BY scan_id ORDER BY rule_order, file_path, line_number) AS INT) AS position
  FROM {_CODE}) WHERE position <= 30"""))
def findings_top30(spark, sf_dir):
    found = code_scan(inputs.files(spark, sf_dir), with_snippet=False)
    top = fnd.top_findings(found, ["rule_order", "file_path", "line_number"], 30)
    return top.select("scan_id", "file_path", "rule_id", "line_number", "position")


@query("findings_top30_large", with_inputs("files", query=f"""
SELECT {_KEY}, position FROM (SELECT *, CAST(row_number() OVER (PARTITION BY scan_id ORDER BY rule_order, file_path, line_number) AS INT) AS position
  FROM (SELECT * REPLACE (CASE WHEN file_path LIKE '%.py' THEN 'scan-py' ELSE 'scan-rest' END AS scan_id) FROM {_CODE})) WHERE position <= 30"""))
def findings_top30_large(spark, sf_dir):
    """The same over two large scans, of which each has more findings than are shown."""
    files = inputs.files(spark, sf_dir).withColumn("scan_id", F.when(F.col("file_path").endswith(".py"), "scan-py").otherwise("scan-rest"))
    top = fnd.top_findings(code_scan(files, with_snippet=False), ["rule_order", "file_path", "line_number"], 30)
    return top.select("scan_id", "file_path", "rule_id", "line_number", "position")


@query("prioritise", with_inputs("files", query=f"""
SELECT {_KEY}, severity FROM {_CODE} ORDER BY CASE severity WHEN 'critical' THEN 5 WHEN 'high' THEN 4 WHEN 'medium' THEN 3
  WHEN 'low' THEN 2 WHEN 'info' THEN 1 ELSE 0 END DESC, scan_id, file_path, line_number, rule_id"""))
def prioritise_query(spark, sf_dir):
    found = code_scan(inputs.files(spark, sf_dir), with_snippet=False)
    return fnd.prioritise(found.select("scan_id", "file_path", "rule_id", "line_number", "severity"))


@query("finding_grouping", with_inputs("files", query=f"""
SELECT category, severity, count(*) AS n_findings FROM {_CODE} JOIN {sql.code_rule_values('category')} USING (rule_id) GROUP BY ALL"""))
def finding_grouping(spark, sf_dir):
    return summaries.group_findings(code_scan(inputs.files(spark, sf_dir), with_snippet=False))


@query("finding_suppression", with_inputs("files", query=f"""
SELECT {_KEY} FROM {_CODE} WHERE regexp_extract(file_path, '([0-9]+)', 1) NOT IN (SELECT CAST(doc_id AS VARCHAR) FROM labels WHERE toxic = 1)"""))
def finding_suppression(spark, sf_dir):
    """Files labelled toxic stand for suppressed ones."""
    toxic = inputs.table(spark, sf_dir, "labels", "doc_id", "toxic").where("toxic = 1").select(F.col("doc_id").cast("string").alias("doc"))
    found = code_scan(inputs.files(spark, sf_dir), with_snippet=False).withColumn("doc", F.regexp_extract("file_path", "([0-9]+)", 1))
    return fnd.suppress(found, toxic, ["doc"]).select("scan_id", "file_path", "rule_id", "line_number")


@query("baseline_compare", with_inputs("files", "old_files", query=f"""
SELECT file_path, rule_id, line_number, CASE WHEN o.r IS NULL THEN 'new' WHEN n.r IS NULL THEN 'fixed' ELSE 'same' END AS status
FROM (SELECT DISTINCT file_path, rule_id, line_number, 1 AS r FROM {_CODE}) n FULL JOIN
  (SELECT DISTINCT file_path, rule_id, line_number, 1 AS r FROM ({sql.code_hits('old_files')})) o USING (file_path, rule_id, line_number)"""))
def baseline_compare(spark, sf_dir):
    return fnd.compare_baseline(*[code_scan(f(spark, sf_dir), with_snippet=False) for f in (inputs.files, inputs.old_files)])


@query("severity_color", with_inputs("files", query=f"""
SELECT severity, CASE severity WHEN 'critical' THEN '#ef4444' WHEN 'high' THEN '#f97316' WHEN 'medium' THEN '#eab308'
  WHEN 'low' THEN '#22c55e' ELSE '#6b7280' END AS color, count(*) AS n FROM {_CODE} GROUP BY ALL"""))
def severity_color_query(spark, sf_dir):
    found = code_scan(inputs.files(spark, sf_dir), with_snippet=False).groupBy("severity").agg(F.count("*").alias("n"))
    return found.withColumn("color", severity_color(F.col("severity")))


@query("severity_normalise", """
SELECT event_id, lower(coalesce(nullif(CASE WHEN event_id % 3 = 0 THEN upper(event_type) ELSE '' END, ''),
  CASE WHEN event_id % 3 = 1 THEN event_type END, 'info')) AS level FROM events""")
def severity_normalise_query(spark, sf_dir):
    e = F.col("event_id")
    return inputs.table(spark, sf_dir, "events", "event_id", "event_type").select("event_id", severity_normalise(
        F.when(e % 3 == 0, F.upper("event_type")).otherwise(""), F.when(e % 3 == 1, F.col("event_type"))).alias("level"))
