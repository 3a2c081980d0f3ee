"""OWASP Top 10 checks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..rules import OWASP_CHECKS, OWASP_RULES, OwaspRule
from .matching import hit_count, locate


def _rule_value(rules: Sequence[OwaspRule], name: str) -> Column:
    return F.element_at(F.array(*[F.lit(getattr(r, name)) for r in rules]), F.col("rule_no") + 1)


def owasp_hits(files: DataFrame, rules: Sequence[OwaspRule] = OWASP_RULES) -> DataFrame:
    """Matches per (file, pattern, line): ``n_hits`` start on that line."""
    hits = locate(files.select("scan_id", "file_path", "code"), rules)
    return hits.select(
        "scan_id", "file_path",
        _rule_value(rules, "owasp_id").alias("owasp_id"),
        _rule_value(rules, "pattern_no").alias("pattern_no"),
        _rule_value(rules, "finding_text").alias("finding_text"),
        "line_number",
        hit_count(F.col("line_marked")).alias("n_hits"),
    )


def owasp_scan(files: DataFrame, rules: Sequence[OwaspRule] = OWASP_RULES) -> DataFrame:
    """One row per match, also for several matches on a line; any language."""
    hits = owasp_hits(files, rules)
    return hits.select(
        "scan_id", "file_path", "owasp_id", "pattern_no", "line_number",
        F.concat(F.lit("Line "), F.col("line_number").cast("string"), F.lit(": "), F.col("finding_text")).alias("finding"),
        F.explode(F.sequence(F.lit(1), F.col("n_hits"))).alias("occurrence"),
    )


def _checks() -> Column:
    return F.array(*[
        F.struct(F.lit(c.owasp_id).alias("owasp_id"), F.lit(c.category).alias("category"),
                 F.lit(c.severity).alias("severity"), F.lit(c.description).alias("description"))
        for c in OWASP_CHECKS
    ])


def owasp_status(files: DataFrame, by: Sequence[str] = ("scan_id",)) -> DataFrame:
    """All ten checks per scan (or per file) with PASS or FAIL and finding counts.

    Checks without a hit come from a zero row per unit, so one aggregation does
    it, and its partial sums leave little to shuffle however large a scan is.
    """
    hits = owasp_hits(files).select(*by, "owasp_id", F.col("n_hits").cast("long").alias("n"))
    zero = (
        files.select(*by).distinct()
        .select(*by, F.explode(F.array(*[F.lit(c.owasp_id) for c in OWASP_CHECKS])).alias("owasp_id"))
        .withColumn("n", F.lit(0).cast("long"))
    )
    counted = hits.unionByName(zero).groupBy(*by, "owasp_id").agg(F.sum("n").alias("n_findings"))
    check = F.get(F.filter(_checks(), lambda c: c["owasp_id"] == F.col("owasp_id")), F.lit(0))
    return counted.select(
        *by, "owasp_id", check["category"].alias("category"), check["severity"].alias("severity"),
        F.when(F.col("n_findings") > 0, "FAIL").otherwise("PASS").alias("status"), "n_findings",
    )


def owasp_totals(status: DataFrame, by: Sequence[str] = ("scan_id",)) -> DataFrame:
    """Passed, failed and total checks per scan (or per file)."""
    return status.groupBy(*by).agg(
        F.count_if(F.col("status") == "PASS").alias("passed"),
        F.count_if(F.col("status") == "FAIL").alias("failed"),
        F.count("*").alias("total"),
    )
