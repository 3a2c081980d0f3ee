"""Counts per scan.

All are sums of conditions, so they shrink on the map side and a scan that holds
a large share of the rows costs no more than others.  Scans without findings get
zero rows from the list of scans, which takes no join.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.severity import LEVELS, risk_score


def _with_all_scans(findings: DataFrame, scans: DataFrame | None, *columns: str) -> DataFrame:
    """Findings plus one all-null row per scan."""
    rows = findings.select("scan_id", *columns)
    if scans is None:
        return rows
    nulls = [F.lit(None).cast(rows.schema[c].dataType).alias(c) for c in columns]
    return rows.unionByName(scans.select("scan_id").distinct().select("scan_id", *nulls))


def severity_summary(findings: DataFrame, scans: DataFrame | None = None) -> DataFrame:
    """Findings per scan and level; levels and scans without findings show zero."""
    return _with_all_scans(findings, scans, "severity").groupBy("scan_id").agg(
        *[F.count_if(F.col("severity") == level).alias(level) for level in LEVELS])


def finding_count(findings: DataFrame, scans: DataFrame | None = None) -> DataFrame:
    return _with_all_scans(findings, scans, "severity").groupBy("scan_id").agg(F.count("severity").alias("n_findings"))


def scan_risk(findings: DataFrame, scans: DataFrame | None = None) -> DataFrame:
    """Overall risk score of a scan, from the severities of all its findings."""
    return _with_all_scans(findings, scans, "severity").groupBy("scan_id").agg(
        F.count("severity").alias("n_findings"), risk_score(F.col("severity")).alias("risk_score"))


def _head_figures(rows: DataFrame, dep_risk: DataFrame) -> DataFrame:
    rows = rows.select("scan_id", "tag", F.lit(1).cast("long").alias("n")).unionByName(
        dep_risk.select("scan_id", F.lit("cve").alias("tag"), F.col("n_vulns").cast("long").alias("n")))
    total = lambda tag: F.coalesce(F.sum(F.when(F.col("tag") == tag, F.col("n"))), F.lit(0).cast("long"))
    return rows.groupBy("scan_id").agg(
        *[total(level).alias(f"{level}_count") for level in LEVELS if level != "info"],
        total("secret").alias("secrets_count"), total("cve").alias("dep_vuln_count"))


def report_counts(findings: DataFrame, secrets: DataFrame, dep_risk: DataFrame) -> DataFrame:
    """The six figures at the head of a report, in one aggregation over the
    tagged union of the three tables."""
    return _head_figures(findings.select("scan_id", F.col("severity").alias("tag"))
                         .unionByName(secrets.select("scan_id", F.lit("secret").alias("tag"))), dep_risk)


def report_counts_of_scan(found: DataFrame, dep_risk: DataFrame) -> DataFrame:
    """The same figures from the code and secrets findings of ``scan_full``, for which the texts are read once."""
    tag = F.when(F.col("kind") == "secrets", "secret").when(F.col("kind") == "code", F.col("severity"))
    return _head_figures(found.select("scan_id", tag.alias("tag")).where("tag is not null"), dep_risk)


def dashboard_stats(findings: DataFrame, scans: DataFrame) -> DataFrame:
    """Scans, critical (with high), warnings and clean scans.

    Medium findings count as warnings only in scans without critical or high ones.
    """
    per_scan = severity_summary(findings, scans)
    severe = F.col("critical") + F.col("high")
    total = severe + F.col("medium") + F.col("low") + F.col("info")
    return per_scan.agg(
        F.count("*").alias("scans"),
        F.coalesce(F.sum(severe), F.lit(0)).alias("critical"),
        F.coalesce(F.sum(F.when(severe == 0, F.col("medium"))), F.lit(0)).alias("warnings"),
        F.count_if(total == 0).alias("clean"),
    )


def group_findings(findings: DataFrame) -> DataFrame:
    """Findings per category and severity."""
    return findings.groupBy("category", "severity").agg(F.count("*").alias("n_findings"))
