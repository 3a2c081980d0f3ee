"""Queries over the scan log, conversations, reports and streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.severity import LEVELS
from ..operators import findings as fnd
from ..operators import increments
from ..operators import summaries
from ..operators.code_scan import code_scan
from ..operators.dependencies import dependency_findings, dependency_risk
from ..operators.secrets import secret_scan
from ..prompts import assembly as prompts
from ..session import few_partitions, shared_folder, written
from ..sinks import export, ranges, report, store
from ..sources.advisories import parse_osv
from ..streaming import scan_events
from ..streaming import scan_stream as streams
from . import inputs, sql
from .inputs import quote, with_inputs
from .registry import query
from .scan_queries import _CODE, _FULL, _SECRET

AS_OF = "2026-01-01 00:00 UTC"


def _report_ctes() -> str:
    return with_inputs("files", "osv", "report_deps", query="").rstrip() + ",\n" + sql.matches_ctes("report_deps")


def _report_inputs(spark, sf_dir):
    files = inputs.files(spark, sf_dir)
    packages = dependency_findings(inputs.report_deps(spark, sf_dir), parse_osv(inputs.osv_records(spark, sf_dir)))
    return code_scan(files), secret_scan(files), packages


# --- counts and report --------------------------------------------------------------------

_COUNTS = f"""counts AS (SELECT scan_id, {', '.join(f"CAST(sum(CASE WHEN tag = '{s}' THEN n ELSE 0 END) AS BIGINT) AS {s}_count" for s in ('critical', 'high', 'medium', 'low'))},
  CAST(sum(CASE WHEN tag = 'secret' THEN n ELSE 0 END) AS BIGINT) AS secrets_count,
  CAST(sum(CASE WHEN tag = 'cve' THEN n ELSE 0 END) AS BIGINT) AS dep_vuln_count
FROM (SELECT scan_id, severity AS tag, 1 AS n FROM {_CODE} UNION ALL SELECT scan_id, 'secret', 1 FROM {_SECRET}
  UNION ALL SELECT scan_id, 'cve', n_vulns FROM risk) GROUP BY scan_id)"""


@query("report_counts", _report_ctes() + ",\n" + _COUNTS + "\nSELECT * FROM counts")
def report_counts(spark, sf_dir):
    files = inputs.files(spark, sf_dir).withColumn("types", F.array(F.lit("code"), F.lit("secrets")))
    risk = dependency_risk(inputs.report_deps(spark, sf_dir), parse_osv(inputs.osv_records(spark, sf_dir)))
    return summaries.report_counts_of_scan(fnd.scan_full(files, scan_types="types"), risk)


def _fill_sql(name: str, /, **columns: str) -> str:
    return "(" + " || ".join(columns[t] if is_column else quote(t) for is_column, t in report.pieces(name)) + ")"


def _shown_sql(text: str, before: str = "", after: str = "", empty: str = report.DASH) -> str:
    return f"CASE WHEN coalesce({text}, '') = '' THEN {quote(empty)} ELSE {quote(before)} || {sql.escape(text)} || {quote(after)} END"


def _report_sql() -> str:
    place = "'<code>' || " + sql.escape("file_path") + " || '</code> :' || CAST(line_number AS VARCHAR)"
    color = ("CASE severity WHEN 'critical' THEN '#ef4444' WHEN 'high' THEN '#f97316' WHEN 'medium' THEN '#eab308' "
             "WHEN 'low' THEN '#22c55e' ELSE '#6b7280' END")
    text = lambda c: f"CAST({c} AS VARCHAR)"
    generated = quote(AS_OF)
    from .scan_queries import _LINES, _SNIPPET
    details = sql.code_rule_values("title", "category", "description", "remediation", "cwe_id")
    found = f"""(SELECT c.*, title, category, description, remediation, cwe_id, {_SNIPPET} AS code_snippet FROM {_CODE} c JOIN {details} USING (rule_id)
      JOIN (SELECT file_path, {_LINES} AS lines FROM (SELECT file_path, string_split(code, chr(10)) AS p FROM files)) USING (file_path))"""
    sections = [
        ("findings", report.FINDINGS, f"(SELECT scan_id, count(*) AS n FROM {_CODE} GROUP BY ALL)"),
        ("secrets", report.SECRETS, f"(SELECT scan_id, count(*) AS n FROM {_SECRET} GROUP BY ALL)"),
        ("packages", report.PACKAGES, "(SELECT scan_id, count(*) AS n FROM risk GROUP BY ALL)"),
    ]
    parts = [
        f"SELECT scan_id, {report.HEAD} AS part, {report.OPEN} AS kind, '' AS k1, CAST(0 AS BIGINT) AS k2, '' AS k3, "
        + _fill_sql("head", title="'Security Report'", generated=generated, scan=sql.escape("scan_id"),
                    **{c: text(c) for c in ("critical_count", "high_count", "medium_count", "low_count", "secrets_count", "dep_vuln_count")})
        + " AS html FROM counts",
        f"SELECT scan_id, {report.FOOT}, {report.CLOSE}, '', 0, '', {_fill_sql('foot', generated=generated)} FROM counts",
    ]
    for name, part, counted in sections:
        opened = _fill_sql(f"{name}_open", n=text("n"))
        parts.append(f"SELECT scan_id, {part}, {report.OPEN}, '', 0, '', {opened} FROM {counted}")
        parts.append(f"SELECT scan_id, {part}, {report.CLOSE}, '', 0, '', {_fill_sql('close')} FROM {counted}")
    parts.append(
        f"SELECT scan_id, {report.FINDINGS}, {report.ROW}, file_path, CAST(rule_order AS BIGINT) * 1000000000 + line_number, '', " + _fill_sql(
            "finding", color=color, severity="upper(severity)", title=_shown_sql("title"),
            description=_shown_sql("description", empty=""), snippet=_shown_sql("code_snippet", "<pre>", "</pre>", ""),
            fix=_shown_sql("remediation", "<br>Fix: ", "", ""), category=_shown_sql("category"), place=place,
            cwe=_shown_sql("cwe_id", "<code>", "</code>")) + f" FROM {found}")
    parts.append(
        f"SELECT scan_id, {report.SECRETS}, {report.ROW}, file_path, line_number, id, " + _fill_sql(
            "secret", color=color, severity="upper(severity)", type=_shown_sql("type"), masked=_shown_sql("masked_value"),
            place=place) + f" FROM {_SECRET}")
    band = "CASE WHEN risk_score >= 7 THEN 'critical' WHEN risk_score >= 4 THEN 'high' WHEN risk_score >= 1 THEN 'medium' ELSE 'low' END"
    parts.append(
        f"SELECT scan_id, {report.PACKAGES}, {report.ROW}, '', ordinal, name || ' ' || version, " + _fill_sql(
            "package", name=_shown_sql("name"), version=_shown_sql("version", empty=""), band=band,
            risk="CASE WHEN risk_score >= 1 THEN printf('%.1f/10', risk_score) ELSE '0.0/10' END",
            none="CASE WHEN n_vulns = 0 THEN " + quote(report.DASH) + " ELSE '' END") + " FROM risk")
    parts.append(
        f"SELECT scan_id, {report.PACKAGES}, {report.ROW}, '', ordinal, name || ' ' || k.version || chr(10) || cve_id, "
        + _fill_sql("cve", cve="cve_id")
        + " FROM keyed k JOIN matches m ON k.ecosystem = m.ecosystem AND k.name_key = m.name_key AND k.version = m.version")
    return _report_ctes() + ",\n" + _COUNTS + "\n" + "\nUNION ALL ".join(parts)


@query("sink_report_html", _report_sql())
def sink_report_html(spark, sf_dir):
    tables = zip(_report_inputs(spark, sf_dir), ("findings", "secrets", "packages"))
    return report.report_lines(*[written(df, name) for df, name in tables], generated=AS_OF)


# --- scan log -----------------------------------------------------------------------------

@query("sink_json_export", with_inputs("scan_log", query="""
SELECT scan_id, '{' || chr(10) || '  "id": "' || scan_id || '",' || chr(10) || '  "type": "' || type || '",' || chr(10)
  || '  "findings": ' || CAST(n_findings AS VARCHAR) || ',' || chr(10) || '  "timestamp": "' || strftime(ts, '%Y-%m-%dT%H:%M:%S.%g') || 'Z"' || chr(10) || '}' AS json
FROM scan_log"""))
def sink_json_export(spark, sf_dir):
    return export.export_json(inputs.scan_log(spark, sf_dir))


@query("sink_json_ranges", with_inputs("scan_log", query="""
SELECT scan_id, '{"id":"' || scan_id || '","type":"' || type || '","findings":' || CAST(n_findings AS VARCHAR) || ',"seq":' || CAST(seq AS VARCHAR) || '}' AS json
FROM scan_log"""))
def sink_json_ranges(spark, sf_dir):
    """The log of every scan as JSON lines in few files, read back through the index."""
    path = shared_folder(spark, "json-ranges")
    fields = F.struct(F.col("scan_id").alias("id"), "type", F.col("n_findings").alias("findings"), "seq")
    ranges.write_ranges(inputs.scan_log(spark, sf_dir).withColumn("json", F.to_json(fields)), path, "json", ["ts", "seq"])
    texts = ranges.read_texts(spark, path)
    # Every text ends with a newline, behind which nothing comes.
    lines = texts.select(F.col("key").alias("scan_id"), F.explode(F.split("text", "\n", -1)).alias("json"))
    return lines.where("json != ''")


@query("sink_report_ranges", f"""
SELECT scan_id, CAST(sum(strlen(html) + 1) AS BIGINT) AS n_bytes, count(*) AS n_lines FROM ({_report_sql()}) GROUP BY scan_id""")
def sink_report_ranges(spark, sf_dir):
    """HTML reports of all scans in few files: their sizes, as the index and the files have them."""
    found, secrets, packages = _report_inputs(spark, sf_dir)
    path = shared_folder(spark, "report-ranges")
    lines = report.report_lines(written(found, "findings"), written(secrets, "secrets"), written(packages, "packages"), AS_OF)
    lines = written(lines, "report-lines")
    ranges.write_ranges(lines, path, "html", report.ORDER)
    texts = ranges.read_texts(spark, path).groupBy("key").agg(F.sum(F.octet_length("text")).alias("n_bytes"))
    counted = lines.groupBy("scan_id").agg(F.count("*").alias("n_lines"))
    return texts.withColumnRenamed("key", "scan_id").join(counted, "scan_id")


_LATEST = """SELECT scan_id, ts, seq, type, n_findings FROM scan_log
QUALIFY row_number() OVER (PARTITION BY scan_id ORDER BY ts DESC, seq DESC) = 1"""


@query("latest_scan", with_inputs("scan_log", query=_LATEST))
def latest_scan(spark, sf_dir):
    return fnd.latest_scan(inputs.scan_log(spark, sf_dir), "seq")


@query("sink_scan_store", with_inputs("scan_log", query=_LATEST))
def sink_scan_store(spark, sf_dir):
    """Written to the store as an append, then read back through the latest view."""
    path = shared_folder(spark, "scan-store")
    store.append_scans(inputs.scan_log(spark, sf_dir), path)
    return store.read_latest(spark, path)


@query("recent_scans5", with_inputs("scan_log", query="""
SELECT scan_id, ts, type, n_findings FROM scan_log ORDER BY ts DESC, scan_id LIMIT 5"""))
def recent_scans5(spark, sf_dir):
    return fnd.recent_scans(inputs.scan_log(spark, sf_dir).select("scan_id", "ts", "type", "n_findings"), 5)


@query("scan_history", with_inputs("scan_log", query="""
SELECT scan_id, CAST(ts AS DATE) AS day, count(*) AS n_scans, CAST(sum(n_findings) AS BIGINT) AS n_findings FROM scan_log GROUP BY ALL"""))
def scan_history(spark, sf_dir):
    return inputs.scan_log(spark, sf_dir).groupBy("scan_id", F.to_date("ts").alias("day")).agg(
        F.count("*").alias("n_scans"), F.sum("n_findings").alias("n_findings"))


# --- prompts ----------------------------------------------------------------------------------

_NL = "chr(10)"


def _remediation_sql() -> str:
    from .scan_queries import _LINES, _SNIPPET
    details = sql.code_rule_values("title", "category", "description", "remediation", "cwe_id", "owasp_category")
    parts = [
        "'**Vulnerability:** ' || title", "'**Category:** ' || category", "'**Severity:** ' || upper(severity)",
        "'**Description:** ' || description", "'**CWE:** ' || cwe_id", "'**OWASP:** ' || owasp_category",
        f"{_NL} || '**Vulnerable code (' || language || '):**' || {_NL} || '```' || language || {_NL} || nullif(code_snippet, '') || {_NL} || '```'",
        f"{_NL} || '**Existing hint:** ' || remediation",
    ]
    return with_inputs("files", query=f"""
SELECT scan_id, file_path, rule_id, line_number, concat_ws({_NL}, {', '.join(parts)}) AS prompt
FROM (SELECT c.*, language, title, category, description, remediation, cwe_id, owasp_category, {_SNIPPET} AS code_snippet
  FROM {_CODE} c JOIN {details} USING (rule_id)
  JOIN (SELECT file_path, language, {_LINES} AS lines FROM (SELECT file_path, language, string_split(code, chr(10)) AS p FROM files)) USING (file_path))""")


@query("remediation_prompt", _remediation_sql())
def remediation_prompt(spark, sf_dir):
    found = code_scan(inputs.files(spark, sf_dir), keep=("language",))
    c = F.col
    return found.select("scan_id", "file_path", "rule_id", "line_number", prompts.remediation_prompt(
        title=c("title"), category=c("category"), severity=c("severity"), description=c("description"), cwe=c("cwe_id"),
        owasp=c("owasp_category"), snippet=c("code_snippet"), context=F.lit(None).cast("string"), hint=c("remediation"),
        language=c("language")).alias("prompt"))


@query("remediation_offline", with_inputs("files", query=f"""
SELECT scan_id, rule_id, {quote(prompts.OFFLINE_REMEDIATION)} AS remediation, count(*) AS n FROM {_CODE} GROUP BY ALL"""))
def remediation_offline(spark, sf_dir):
    found = code_scan(inputs.files(spark, sf_dir), with_snippet=False)
    return found.groupBy("scan_id", "rule_id").agg(F.count("*").alias("n")).withColumn(
        "remediation", F.lit(prompts.OFFLINE_REMEDIATION))


@query("review_prompt", with_inputs("submissions", query="""
SELECT scan_id, doc_id, 'Please perform a thorough security code review of the following ' || lang || ' code. Identify all security vulnerabilities, '
  || 'classify them by OWASP category and CWE ID, and provide specific remediation for each finding.' || chr(10) || chr(10)
  || '```' || lang || chr(10) || code || chr(10) || '```'
  || CASE WHEN coalesce(file_path, '') <> '' THEN chr(10) || chr(10) || 'Additional context: ' || file_path ELSE '' END AS prompt
FROM (SELECT *, coalesce(language, 'python') AS lang FROM submissions) WHERE coalesce(code, '') <> ''"""))
def review_prompt(spark, sf_dir):
    requests = inputs.submissions(spark, sf_dir).where("code <> ''")
    return requests.select("scan_id", "doc_id", prompts.review_prompt(
        F.col("code"), F.coalesce("language", F.lit("python")), F.col("file_path")).alias("prompt"))


_SYSTEM = quote(prompts.DEFAULT_SYSTEM_PROMPT)


@query("chat_messages", f"""
SELECT conv_id, CAST(0 AS BIGINT) AS position, 'system' AS role, {_SYSTEM} || coalesce(chr(10) || chr(10) || '## Scan Context' || chr(10) || context, '') AS content
FROM (SELECT DISTINCT conv_id FROM conversations) LEFT JOIN (SELECT doc_id AS conv_id, source || ' ' || lang AS context FROM documents) USING (conv_id)
UNION ALL SELECT conv_id, turn + 1, role, text FROM conversations""")
def chat_messages(spark, sf_dir):
    context = inputs.table(spark, sf_dir, "documents", "doc_id", "source", "lang").select(
        F.col("doc_id").alias("conv_id"), F.concat_ws(" ", "source", "lang").alias("context"))
    return prompts.chat_messages(inputs.table(spark, sf_dir, "conversations"), context)


@query("split_system", """
SELECT conv_id, 'system' AS kind, turn, role, text AS content FROM conversations WHERE role = 'system'
QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn) = 1
UNION ALL SELECT conv_id, 'message', turn, role, text FROM conversations WHERE role <> 'system'""")
def split_system(spark, sf_dir):
    return prompts.split_system(inputs.table(spark, sf_dir, "conversations"))


@query("flatten_transcript", "SELECT conv_id, turn, role || ': ' || text AS line FROM conversations")
def flatten_transcript(spark, sf_dir):
    return prompts.flatten_transcript(inputs.table(spark, sf_dir, "conversations"))


@query("chat_fallback", f"""
SELECT conv_id, {quote(prompts.OFFLINE_CHAT_BEFORE)} || max_by(text, turn) || {quote(prompts.OFFLINE_CHAT_AFTER)} AS reply FROM conversations GROUP BY conv_id""")
def chat_fallback(spark, sf_dir):
    return prompts.chat_fallback(inputs.table(spark, sf_dir, "conversations"))


# --- streaming --------------------------------------------------------------------------------

_DOCUMENTS = "doc_id BIGINT, text STRING, lang STRING, source STRING, n_chars BIGINT"
_PERIOD = "(day(ts) - 1) // 8"  # 0 to 3: the events span January


def _period():
    return F.floor((F.dayofmonth("ts") - 1) / 8).cast("int")


def _in_batches(df, batch, batches: int = 4, files: int = 4) -> str:
    """The rows of each batch as ``files`` files, one batch after another, so that a stream of that many files per trigger takes them in turn."""
    folder = shared_folder(df.sparkSession, "stream-input")
    df = df.withColumn("__batch", batch)
    for i in range(batches):
        df.where(F.col("__batch") == i).drop("__batch").repartition(files).write.mode("append").parquet(folder)
    return folder


_EVENTS = "event_id BIGINT, ts TIMESTAMP, user_id BIGINT, event_type STRING, value DOUBLE, props STRING"


def _run(spark, stream, purpose: str):
    """Run a stream over all input there is, and read its output files."""
    path, checkpoint = shared_folder(spark, purpose), shared_folder(spark, f"{purpose}-checkpoint")
    streams.write_stream(stream, path, checkpoint).awaitTermination()
    return spark.read.schema(stream.schema).parquet(path)


_ASKED = "CASE CAST(regexp_extract(file_path, '([0-9]+)', 1) AS BIGINT) % 4 WHEN 0 THEN ['secrets', 'code', 'owasp'] WHEN 1 THEN ['code'] WHEN 2 THEN ['owasp', 'secrets'] ELSE ['secrets', 'zap'] END"


def _asked(number):
    kinds = [["secrets", "code", "owasp"], ["code"], ["owasp", "secrets"], ["secrets", "zap"]]
    return F.element_at(F.array(*[F.array(*[F.lit(k) for k in ks]) for ks in kinds]), (number % 4 + 1).cast("int"))


@query("stream_scan", with_inputs("files", query=f"SELECT * FROM {_FULL} WHERE list_contains({_ASKED}, kind)"))
def stream_scan(spark, sf_dir):
    docs = streams.read_table_stream(spark, sf_dir, "documents.parquet", _DOCUMENTS)
    if few_partitions(inputs.table(spark, sf_dir, "documents")):
        docs = docs.repartition(spark.sparkContext.defaultParallelism * 4, "doc_id")
    requests = docs.select(*inputs.file_columns(), _asked(F.col("doc_id")).alias("scan_types"))
    return _run(spark, streams.scan_stream(requests).drop("title"), "stream-scan")


@query("scan_messages", with_inputs("files", query=f"""
SELECT file_path AS scan_id, step, CASE step WHEN 'secrets' THEN 'Found ' || CAST(secrets AS VARCHAR) || ' secret(s)'
  WHEN 'code' THEN 'Found ' || CAST(code AS VARCHAR) || ' vulnerability/ies' ELSE 'OWASP: ' || CAST(10 - failed AS VARCHAR) || '/10 passed' END AS message
FROM (SELECT file_path, unnest(list_filter(['secrets', 'code', 'owasp'], lambda s: list_contains({_ASKED}, s))) AS step, secrets, code, failed
  FROM (SELECT file_path, count(*) FILTER (WHERE kind = 'secrets') AS secrets, count(*) FILTER (WHERE kind = 'code') AS code,
      count(DISTINCT CASE WHEN kind = 'owasp' THEN split_part(rule_id, '#', 1) END) AS failed
    FROM files LEFT JOIN {_FULL} USING (file_path) GROUP BY file_path))"""))
def scan_messages(spark, sf_dir):
    """Every file is one request."""
    number = F.regexp_extract("file_path", "([0-9]+)", 1).cast("long")
    requests = inputs.files(spark, sf_dir).withColumns({"scan_id": F.col("file_path"), "scan_types": _asked(number)})
    return streams.step_messages(requests, streams.scan_stream(requests))


def _requests(messages):
    return streams.parse_requests(messages.select(*inputs.message_columns()))


_PROGRESS = """(SELECT scan_id, total, unnest([
  CASE WHEN s THEN {'seq': 0, 'step': 'secrets', 'phase': 'start', 'progress': 10, 'message': 'Scanning for secrets and credentials...'} END,
  CASE WHEN s THEN {'seq': 1, 'step': 'secrets', 'phase': 'end', 'progress': CAST(trunc(1.0 / total * 90) AS INT) + 5, 'message': NULL} END,
  CASE WHEN c THEN {'seq': 2, 'step': 'code', 'phase': 'start', 'progress': CAST(trunc(s::INT / total * 90) AS INT) + 5, 'message': 'Running static analysis...'} END,
  CASE WHEN c THEN {'seq': 3, 'step': 'code', 'phase': 'end', 'progress': CAST(trunc((s::INT + 1) / total * 90) AS INT) + 5, 'message': NULL} END,
  CASE WHEN o THEN {'seq': 4, 'step': 'owasp', 'phase': 'start', 'progress': CAST(trunc((s::INT + c::INT) / total * 90) AS INT) + 5, 'message': 'Running OWASP Top 10 checks...'} END,
  CASE WHEN o THEN {'seq': 5, 'step': 'owasp', 'phase': 'end', 'progress': 95, 'message': NULL} END,
  {'seq': 6, 'step': 'complete', 'phase': 'end', 'progress': 100, 'message': 'Scan complete'}]) AS e
FROM (SELECT scan_id, CASE event_id % 4 WHEN 0 THEN 2.0 WHEN 1 THEN 3.0 ELSE 4.0 END AS total,
  event_id % 4 IN (1, 3) AS s, event_id % 4 IN (0, 1) AS c, true AS o FROM messages WHERE event_id % 4 <> 2))"""


@query("scan_progress", with_inputs("messages", query=f"""
SELECT scan_id, e.seq AS seq, e.step AS step, e.phase AS phase, e.progress AS progress, e.message AS message FROM {_PROGRESS} WHERE e IS NOT NULL"""))
def scan_progress(spark, sf_dir):
    requests = _requests(inputs.table(spark, sf_dir, "events"))
    return streams.scan_progress(requests.where("error is null"))


@query("stream_errors", with_inputs("messages", query="""
SELECT scan_id, '{"error":"invalid request","scan_id":"' || scan_id || '"}' AS message FROM messages WHERE NOT json_valid(payload)"""))
def stream_errors(spark, sf_dir):
    events = streams.read_table_stream(spark, sf_dir, "events.parquet", _EVENTS)
    return _run(spark, streams.error_messages(_requests(events)), "stream-errors")


@query("stream_dedup", """
SELECT DISTINCT 'scan-' || CAST(user_id AS VARCHAR) AS scan_id, event_type AS file_path, json_extract_string(props, '$.k') AS rule_id,
  CAST(event_id % 7 AS INT) AS line_number FROM events""")
def stream_dedup(spark, sf_dir):
    """Events stand for findings; the watermark covers the whole month they span."""
    events = streams.read_table_stream(spark, sf_dir, "events.parquet", _EVENTS)
    found = events.select(
        F.concat(F.lit("scan-"), F.col("user_id").cast("string")).alias("scan_id"), F.col("event_type").alias("file_path"),
        F.get_json_object("props", "$.k").alias("rule_id"), (F.col("event_id") % 7).cast("int").alias("line_number"), "ts")
    return _run(spark, streams.first_findings(found, "400 days").drop("ts"), "stream-dedup")


@query("stream_dedup_late", f"""
SELECT DISTINCT 'scan-' || CAST(user_id AS VARCHAR) || '-' || CAST({_PERIOD} AS VARCHAR) AS scan_id, event_type AS file_path, json_extract_string(props, '$.k') AS rule_id,
  CAST(event_id % 7 AS INT) AS line_number FROM events WHERE NOT (day(ts) <= 5 AND event_id % 50 = 0)""")
def stream_dedup_late(spark, sf_dir):
    """Four batches of eight days each.  Some findings are sent again in the next batch, where only the state knows them; some of the
    first five days come in the last batch, behind the watermark (that of two batches before, as Spark has it for late rows), and are dropped."""
    events, period = inputs.table(spark, sf_dir, "events"), _period()
    found = events.select(
        F.concat(F.lit("scan-"), F.col("user_id").cast("string"), F.lit("-"), period.cast("string")).alias("scan_id"), F.col("event_type").alias("file_path"),
        F.get_json_object("props", "$.k").alias("rule_id"), (F.col("event_id") % 7).cast("int").alias("line_number"), "ts", "event_id", period.alias("period"))
    late = (F.dayofmonth("ts") <= 5) & (F.col("event_id") % 50 == 0)
    batch = F.when(late, F.array(F.lit(3))).when(F.col("event_id") % 20 == 1, F.array("period", F.col("period") + 1)).otherwise(F.array("period"))
    rows = found.withColumn("batch", F.explode(batch))
    folder = _in_batches(rows.drop("event_id", "period"), F.col("batch"))
    schema = "scan_id string, file_path string, rule_id string, line_number int, ts timestamp"
    stream = streams.read_table_stream(spark, folder, "*.parquet", schema, files_per_batch=4)
    return _run(spark, streams.first_findings(stream, "10 days").drop("ts"), "stream-dedup-late")


@query("stream_store", with_inputs("scan_log", query=_LATEST))
def stream_store(spark, sf_dir):
    """The scan log as a stream of four batches, upserted into the buckets of the store."""
    log = inputs.scan_log(spark, sf_dir)
    stream = streams.read_table_stream(spark, _in_batches(log, _period()), "*.parquet", _LOG, files_per_batch=4)
    path = shared_folder(spark, "bucket-store")
    streams.write_batches(stream, store.upsert_writer(path, buckets=16), shared_folder(spark, "bucket-store-checkpoint")).awaitTermination()
    return store.read_latest_view(spark, path, log.schema)


# Findings in two sendings of every scan, each in two batches: seq is the half of the month.
_SENT = """SELECT 'scan-' || CAST(user_id AS VARCHAR) AS scan_id, CAST((day(ts) - 1) // 15 AS BIGINT) AS seq,
  CASE WHEN user_id % 10 = 0 THEN NULL ELSE ['critical', 'high', 'medium', 'low', 'info', NULL][CASE WHEN user_id % 3 = 0 THEN 3 + event_id % 4 ELSE 1 + event_id % 6 END] END AS severity FROM events"""
_SENT_COUNTS = "SELECT scan_id, " + ", ".join(f"count(*) FILTER (WHERE severity = '{s}') AS {s}" for s in LEVELS) + f""" FROM (
  SELECT * FROM ({_SENT}) QUALIFY seq = max(seq) OVER (PARTITION BY scan_id)) GROUP BY scan_id"""


def _sent(spark, sf_dir) -> str:
    """The store of counts after a stream of four batches."""
    e, user = F.col("event_id"), F.col("user_id")
    levels = F.array(*[F.lit(s) for s in ("critical", "high", "medium", "low", "info")], F.lit(None).cast("string"))
    at = F.when(user % 3 == 0, e % 4 + 2).otherwise(e % 6).cast("int")
    rows = inputs.table(spark, sf_dir, "events").select(
        F.concat(F.lit("scan-"), user.cast("string")).alias("scan_id"), F.floor((F.dayofmonth("ts") - 1) / 15).cast("long").alias("seq"),
        F.when(user % 10 != 0, F.get(levels, at)).alias("severity"), (e % 2).alias("part"))
    folder = _in_batches(rows, 2 * F.col("seq") + F.col("part"))
    stream = streams.read_table_stream(spark, folder, "*.parquet", "scan_id string, seq long, severity string", files_per_batch=4)
    path = shared_folder(spark, "scan-counts")
    streams.write_batches(stream, increments.stats_writer(path, buckets=8), shared_folder(spark, "scan-counts-checkpoint")).awaitTermination()
    return path


@query("stream_dashboard", f"""
SELECT count(*) AS scans, CAST(sum(critical + high) AS BIGINT) AS critical, CAST(coalesce(sum(CASE WHEN critical + high = 0 THEN medium END), 0) AS BIGINT) AS warnings,
  count(*) FILTER (WHERE critical + high + medium + low + info = 0) AS clean FROM ({_SENT_COUNTS})""")
def stream_dashboard(spark, sf_dir):
    return increments.dashboard(spark, _sent(spark, sf_dir))


@query("stream_severity_summary", _SENT_COUNTS)
def stream_severity_summary(spark, sf_dir):
    return increments.scan_counts(spark, _sent(spark, sf_dir))


_LOG = "scan_id string, ts timestamp, seq long, type string, n_findings long"
_FOUND = "'[' || coalesce(string_agg('\"' || rule_id || ':' || CAST(line_number AS VARCHAR) || '\"', ',' ORDER BY '\"' || rule_id || ':' || CAST(line_number AS VARCHAR) || '\"')"
_STEPS_OF_FILES = f"""(SELECT file_path, asked, CAST(len(asked) AS DOUBLE) AS total, list_contains(asked, 'secrets') AS s, list_contains(asked, 'code') AS c, list_contains(asked, 'owasp') AS o,
  'Found ' || CAST(secrets AS VARCHAR) || ' secret(s)' AS secrets_said, 'Found ' || CAST(code AS VARCHAR) || ' vulnerability/ies' AS code_said,
  'OWASP: ' || CAST(10 - failed AS VARCHAR) || '/10 passed' AS owasp_said, secrets_found, code_found,
  '{{"passed":' || CAST(10 - failed AS VARCHAR) || ',"failed":' || CAST(failed AS VARCHAR) || ',"total":10}}' AS owasp_found
  FROM (SELECT file_path, {_ASKED} AS asked, count(*) FILTER (WHERE kind = 'secrets') AS secrets, count(*) FILTER (WHERE kind = 'code') AS code,
      count(DISTINCT CASE WHEN kind = 'owasp' THEN split_part(rule_id, '#', 1) END) AS failed,
      {_FOUND} FILTER (WHERE kind = 'secrets'), '') || ']' AS secrets_found, {_FOUND} FILTER (WHERE kind = 'code'), '') || ']' AS code_found
    FROM files LEFT JOIN {_FULL} USING (file_path) GROUP BY file_path))"""


@query("stream_progress", with_inputs("files", query=f"""
SELECT file_path AS scan_id, CAST(e.seq AS INT) AS seq, e.step AS step, e.phase AS phase, e.progress AS progress, e.message AS message, e.payload AS payload FROM (SELECT file_path, unnest([
  CASE WHEN s THEN {{'seq': 0, 'step': 'secrets', 'phase': 'start', 'progress': 10, 'message': 'Scanning for secrets and credentials...', 'payload': NULL}} END,
  CASE WHEN s THEN {{'seq': 1, 'step': 'secrets', 'phase': 'end', 'progress': CAST(trunc(1.0 / total * 90) AS INT) + 5, 'message': secrets_said, 'payload': secrets_found}} END,
  CASE WHEN c THEN {{'seq': 2, 'step': 'code', 'phase': 'start', 'progress': CAST(trunc(s::INT / total * 90) AS INT) + 5, 'message': 'Running static analysis...', 'payload': NULL}} END,
  CASE WHEN c THEN {{'seq': 3, 'step': 'code', 'phase': 'end', 'progress': CAST(trunc((s::INT + 1) / total * 90) AS INT) + 5, 'message': code_said, 'payload': code_found}} END,
  CASE WHEN o THEN {{'seq': 4, 'step': 'owasp', 'phase': 'start', 'progress': CAST(trunc((s::INT + c::INT) / total * 90) AS INT) + 5, 'message': 'Running OWASP Top 10 checks...', 'payload': NULL}} END,
  CASE WHEN o THEN {{'seq': 5, 'step': 'owasp', 'phase': 'end', 'progress': 95, 'message': owasp_said, 'payload': owasp_found}} END,
  {{'seq': 6, 'step': 'complete', 'phase': 'end', 'progress': 100, 'message': 'Scan complete', 'payload': '{{"scan_id":"' || file_path || '"'
    || CASE WHEN s THEN ',"secrets":' || secrets_found ELSE '' END || CASE WHEN c THEN ',"code":' || code_found ELSE '' END || CASE WHEN o THEN ',"owasp":' || owasp_found ELSE '' END || '}}'}}]) AS e
  FROM {_STEPS_OF_FILES}) WHERE e IS NOT NULL"""))
def stream_progress(spark, sf_dir):
    """Every file is one request.  Requests come in three batches, the results of their steps in three others, so that some scans
    wait for results and some results for their requests."""
    number = F.regexp_extract("file_path", "([0-9]+)", 1).cast("long")
    requests = inputs.files(spark, sf_dir).withColumns({"scan_id": F.col("file_path"), "scan_types": _asked(number), "ts": F.lit("2026-01-01").cast("timestamp")})
    results = scan_events.step_results(streams.scan_stream(requests), requests).withColumn("ts", F.lit("2026-01-01").cast("timestamp"))
    asked = _in_batches(requests.select("scan_id", "ts", "scan_types"), F.pmod(F.xxhash64("scan_id"), F.lit(3)), 3, 2)
    told = _in_batches(written(results, "step-results"), F.pmod(F.xxhash64("scan_id", "step"), F.lit(3)), 3, 2)
    events = scan_events.scan_events(
        streams.read_table_stream(spark, asked, "*.parquet", "scan_id string, ts timestamp, scan_types array<string>", files_per_batch=2),
        streams.read_table_stream(spark, told, "*.parquet", "scan_id string, ts timestamp, step string, message string, payload string", files_per_batch=2),
        buckets=max(64, inputs.table(spark, sf_dir, "documents").count() // 1000))
    return _run(spark, events, "stream-progress")
