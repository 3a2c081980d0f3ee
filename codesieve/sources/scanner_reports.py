"""JSON reports of three external scanners as findings tables.

Each function takes rows with a text column ``report`` and keeps the other
columns as keys.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import mask_tail, split_lines

# Numbers and booleans are read as text and cast, so that a quoted number does
# not cost the whole record.
_GITLEAKS = ("array<struct<Secret:string,Fingerprint:string,Match:string,RuleID:string,"
             "Description:string,File:string,StartLine:string>>")
_TRUFFLEHOG = ("Raw string, RawV2 string, DetectorName string, Verified string, StructuredData struct<id:string>, "
               "SourceMetadata struct<Data:struct<Filesystem:struct<file:string,line:string>,"
               "Git:struct<file:string,lineNumber:string>>>, __corrupt string")
_BEARER = ("array<struct<id:string,rule_id:string,title:string,description:string,category:string,"
           "filename:string,line_number:string,source:struct<start:string>,code_extract:string,"
           "documentation_url:string,cwe_ids:array<string>,owasp:variant>>")

# Fixed values.
_BEARER_SEVERITY = {"critical": "critical", "high": "high", "medium": "medium", "low": "low", "warning": "low"}


def _line(value: Column) -> Column:
    """Line number as an int; zero means unknown."""
    return F.nullif(value.try_cast("int"), F.lit(0))


def _text(value: Column) -> Column:
    return F.nullif(value, F.lit(""))


def parse_gitleaks(reports: DataFrame) -> DataFrame:
    """Array reports, or a single finding object; broken JSON gives no rows."""
    keys = [c for c in reports.columns if c != "report"]
    f = reports.select(*keys, F.explode(F.from_json("report", _GITLEAKS)).alias("f"))
    fallback = F.substring(F.coalesce("f.Match", F.lit("")), 1, 16)
    return f.select(
        *keys,
        F.concat(F.lit("gl-"), F.coalesce("f.Fingerprint", fallback)).alias("id"),
        F.coalesce("f.RuleID", F.lit("unknown")).alias("type"),
        F.coalesce("f.Description", "f.RuleID", F.lit("Secret detected by gitleaks")).alias("description"),
        mask_tail(F.coalesce("f.Secret", F.lit(""))).alias("masked_value"),
        F.col("f.File").alias("reported_path"),
        F.col("f.StartLine").try_cast("int").alias("line_number"),
        F.lit("critical").alias("severity"),
        F.lit(0.95).alias("confidence"),
    )


def parse_trufflehog(reports: DataFrame) -> DataFrame:
    """JSON-lines reports; blank and broken lines are skipped."""
    keys = [c for c in reports.columns if c != "report"]
    lines = reports.select(*keys, F.explode(split_lines(F.col("report"))).alias("__line"))
    f = (
        lines.where(F.trim("__line") != "")
        .select(*keys, F.explode(F.array(
            F.from_json("__line", _TRUFFLEHOG, {"columnNameOfCorruptRecord": "__corrupt"}))).alias("f"))
        .where(F.col("f").isNotNull() & F.col("f.__corrupt").isNull())
    )
    raw = F.coalesce("f.Raw", "f.RawV2", F.lit(""))
    detector = F.coalesce("f.DetectorName", F.lit("Unknown"))
    data = "f.SourceMetadata.Data"
    return f.select(
        *keys,
        F.concat(F.lit("th-"), F.coalesce(
            "f.StructuredData.id", _text(F.substring(raw, 1, 16)), F.lit("unknown"))).alias("id"),
        detector.alias("type"),
        F.concat(F.lit("TruffleHog detected: "), detector).alias("description"),
        F.when(raw == "", "****").otherwise(mask_tail(raw)).alias("masked_value"),
        F.coalesce(_text(F.col(f"{data}.Filesystem.file")), _text(F.col(f"{data}.Git.file"))).alias("reported_path"),
        F.coalesce(_line(F.col(f"{data}.Filesystem.line")), _line(F.col(f"{data}.Git.lineNumber"))).alias("line_number"),
        F.lit("critical").alias("severity"),
        F.when(F.lower("f.Verified") == "true", 1.0).otherwise(0.0).alias("confidence"),
    )


def parse_bearer(reports: DataFrame) -> DataFrame:
    """Objects of severity to list of findings; values that are no lists are skipped."""
    keys = [c for c in reports.columns if c != "report"]
    groups = reports.select(*keys, F.explode(F.from_json("report", "map<string,variant>")).alias("__key", "__list"))
    listed = groups.where(F.startswith(F.schema_of_variant("__list"), F.lit("ARRAY")))
    f = listed.select(*keys, "__key", F.explode(F.from_json(F.to_json("__list"), _BEARER)).alias("f"))
    pairs = [F.lit(x) for item in _BEARER_SEVERITY.items() for x in item]
    return f.select(
        *keys,
        F.concat(F.lit("bearer-"), F.coalesce("f.id", "f.rule_id", F.lit("unknown"))).alias("id"),
        F.coalesce("f.title", "f.rule_id", F.lit("Bearer finding")).alias("title"),
        F.coalesce("f.description", F.lit("")).alias("description"),
        F.coalesce(F.try_element_at(F.create_map(*pairs), F.lower("__key")), F.lit("medium")).alias("severity"),
        F.coalesce("f.category", F.lit("SAST")).alias("category"),
        F.col("f.filename").alias("reported_path"),
        F.coalesce(_line(F.col("f.line_number")), _line(F.col("f.source.start"))).alias("line_number"),
        F.coalesce("f.code_extract", F.lit("")).alias("code_snippet"),
        F.coalesce("f.documentation_url", F.lit("")).alias("remediation"),
        F.get("f.cwe_ids", F.lit(0)).alias("cwe_id"),
        F.try_variant_get("f.owasp", "$.name", "string").alias("owasp_category"),
    )
