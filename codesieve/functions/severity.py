"""Severity levels, labels, scores and risk."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
LEVELS = ("critical", "high", "medium", "low", "info")
RANK = {"critical": 5, "high": 4, "medium": 3, "low": 2, "info": 1}
RISK_WEIGHT = {"critical": 10, "high": 7, "medium": 4, "low": 1, "info": 0}
LABELS = {"CRITICAL": "critical", "HIGH": "high", "MODERATE": "medium", "MEDIUM": "medium",
          "LOW": "low", "NONE": "info"}
COLORS = {"critical": "#ef4444", "high": "#f97316", "medium": "#eab308", "low": "#22c55e", "info": "#6b7280"}
DEFAULT_COLOR = "#6b7280"

_NUMBER = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"


def _lookup(table: dict, key: Column, default) -> Column:
    pairs = [F.lit(x) for item in table.items() for x in item]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), key), F.lit(default))


def severity_rank(severity: Column) -> Column:
    return _lookup(RANK, severity, 0)


def severity_color(severity: Column) -> Column:
    return _lookup(COLORS, severity, DEFAULT_COLOR)


def severity_normalise(severity: Column, level: Column) -> Column:
    """Severity, else level, else info; an empty text counts as missing."""
    return F.lower(F.coalesce(F.nullif(severity, F.lit("")), F.nullif(level, F.lit("")), F.lit("info")))


def cvss_severity(score: Column) -> Column:
    return (F.when(score >= 9.0, "critical").when(score >= 7.0, "high")
            .when(score >= 4.0, "medium").otherwise("low"))


def label_severity(label: Column) -> Column:
    return _lookup(LABELS, F.upper(label), "medium")


def parse_score(score: Column) -> Column:
    """The number before a slash, or null; full CVSS vectors are no numbers."""
    head = F.trim(F.substring_index(score, "/", 1))
    return F.when(head.rlike(_NUMBER), head.try_cast("double"))


def first_score(entries: Column) -> Column:
    """First parseable score of an advisory's ``severity`` array."""
    scores = F.transform(entries, lambda e: parse_score(e["score"]))
    return F.get(F.filter(scores, lambda s: s.isNotNull()), F.lit(0))


def _stated(specific: Column) -> Column:
    """Severity stated in a ``database_specific`` object: its text label or
    number, whichever of ``severity`` and ``cvss_score`` is set first."""
    def one(value: Column) -> Column:
        text = F.try_variant_get(value, "$", "string")
        is_text = F.schema_of_variant(value) == "STRING"
        number = F.when(~is_text, F.try_variant_get(value, "$", "double"))
        return (F.when(is_text & (text != ""), label_severity(text))
                .when(number != 0, cvss_severity(number)))
    return F.coalesce(one(specific["severity"]), one(specific["cvss_score"]))


def advisory_severity(advisory: Column) -> Column:
    """Score first, then the database's own statement, then that of the first
    affected package, else medium."""
    score = first_score(advisory["severity"])
    return F.coalesce(
        F.when(score.isNotNull(), cvss_severity(score)),
        _stated(advisory["database_specific"]),
        _stated(F.get(advisory["affected"], F.lit(0))["database_specific"]),
        F.lit("medium"),
    )


def cve_severity_label(advisory: Column) -> Column:
    """Upper-case label; without a score, the database's label or UNKNOWN."""
    score = first_score(advisory["severity"])
    stated = F.try_variant_get(advisory["database_specific"]["severity"], "$", "string")
    return F.coalesce(F.when(score.isNotNull(), F.upper(cvss_severity(score))), F.upper(stated), F.lit("UNKNOWN"))


def risk_weight(severity: Column) -> Column:
    return _lookup(RISK_WEIGHT, severity, 0)


def risk_score(severity: Column) -> Column:
    """Aggregate: mean weight, at most 10, 0.0 for no rows."""
    mean = F.avg(F.when(severity.isNotNull(), risk_weight(severity)))
    return F.least(F.lit(10.0), F.coalesce(mean, F.lit(0.0)))


def risk_score_of(severities: Column) -> Column:
    """:func:`risk_score` of an array."""
    weights = F.transform(F.filter(severities, lambda s: s.isNotNull()), lambda s: risk_weight(s).cast("double"))
    mean = F.aggregate(weights, F.lit(0.0), lambda total, w: total + w) / F.nullif(F.size(weights), F.lit(0))
    return F.least(F.lit(10.0), F.coalesce(mean, F.lit(0.0)))


def risk_band(score: Column) -> Column:
    return (F.when(score >= 7, "critical").when(score >= 4, "high")
            .when(score >= 1, "medium").otherwise("low"))


def risk_label(score: Column) -> Column:
    """Text shown for a risk score; anything below 1 shows as 0.0."""
    return F.when(score >= 1, F.format_string("%.1f/10", score)).otherwise("0.0/10")
