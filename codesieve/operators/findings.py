"""All scanners together, ordering, suppression, baselines, history."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.severity import severity_rank
from ..functions.text import shannon_entropy
from ..rules import CODE_RULES, OWASP_CHECKS, OWASP_RULES, SECRET_RULES
from .matching import hit_count, hit_values, locate

# The steps of a scan, in order.
SCAN_TYPES = ("secrets", "code", "owasp")


def scan_full(files: DataFrame, scan_types: str | None = None) -> DataFrame:
    """Findings of all three scanners over the same texts, in one pass.

    The rules of all scanners go through one gate, so each text is read and
    lower-cased once.  ``scan_types`` names an array column that selects the
    scanners per file.
    """
    rules = (*CODE_RULES, *OWASP_RULES, *SECRET_RULES)
    severity_of = {c.owasp_id: c.severity for c in OWASP_CHECKS}
    described = (
        [("code", r.rule_id, r.severity, r.title) for r in CODE_RULES]
        + [("owasp", r.rule_id, severity_of[r.owasp_id], r.finding_text) for r in OWASP_RULES]
        + [("secrets", r.rule_id, r.severity, r.description) for r in SECRET_RULES]
    )
    thresholds = [0.0] * (len(CODE_RULES) + len(OWASP_RULES)) + [r.min_entropy for r in SECRET_RULES]

    def about(i: int) -> Column:
        return F.element_at(F.array(*[F.lit(d[i]) for d in described]), F.col("rule_no") + 1)

    source = files.select(
        "scan_id", "file_path", "code", F.lower(F.coalesce("language", F.lit("python"))).alias("language"),
        *([F.col(scan_types).alias("__types")] if scan_types else []),
    )
    # A rule that the row does not ask for is not even gated.
    wanted = [F.array_contains("__types", d[0]) for d in described] if scan_types else None
    hits = locate(source, rules, language="language", wanted=wanted).withColumn("kind", about(0))
    threshold = F.element_at(F.array(*[F.lit(t) for t in thresholds]), F.col("rule_no") + 1)
    values = F.filter(
        F.array_distinct(hit_values(F.col("line_marked"))),
        lambda v: (threshold == 0) | (shannon_entropy(v) >= threshold),
    )
    copies = (
        F.when(F.col("kind") == "code", F.lit(1))
        .when(F.col("kind") == "owasp", hit_count(F.col("line_marked")))
        .otherwise(F.size(values))
    )
    return (
        hits.withColumn("copies", copies).where(F.col("copies") > 0)
        .select(
            "scan_id", "file_path", "kind", about(1).alias("rule_id"), about(2).alias("severity"),
            about(3).alias("title"), "line_number",
            F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("occurrence"),
        )
    )


def select_scan_types(requests: DataFrame) -> DataFrame:
    """One row per request and known scanner it asks for, in the fixed order;
    requests that name none get all three."""
    asked = F.coalesce("scan_types", F.array(*[F.lit(t) for t in SCAN_TYPES]))
    return requests.withColumn("scan_types", asked).select(
        "*", F.explode(F.array_intersect(F.array(*[F.lit(t) for t in SCAN_TYPES]), F.col("scan_types"))).alias("step"))


def split_inputs(requests: DataFrame) -> DataFrame:
    """Requests with ``reason`` set where they cannot be scanned.

    A secrets request may come with a path only; the others need code.
    """
    no_code = F.coalesce("code", F.lit("")) == ""
    no_path = F.coalesce("file_path", F.lit("")) == ""
    secrets = F.col("step") == "secrets"
    # The reasons given.
    return requests.withColumn(
        "reason",
        F.when(secrets & no_code & no_path, "Provide 'code' or 'file_path'")
        .when(~secrets & no_code, "Provide 'code' field"),
    )


def prioritise(findings: DataFrame) -> DataFrame:
    """Most severe first, then by place.  A sort over ranges of the keys; no
    global numbering, which would need a single task."""
    return findings.orderBy(
        severity_rank(F.col("severity")).desc(), "scan_id", "file_path", "line_number", "rule_id")


def top_findings(findings: DataFrame, order: Sequence[str], k: int = 30) -> DataFrame:
    """The first ``k`` findings of each scan.  Spark keeps only ``k`` rows per
    scan in each task before it shuffles (window group limit)."""
    w = Window.partitionBy("scan_id").orderBy(*order)
    return findings.withColumn("position", F.row_number().over(w)).where(F.col("position") <= k)


def recent_scans(scans: DataFrame, k: int = 5) -> DataFrame:
    """Newest scans first; each task keeps ``k`` rows."""
    return scans.orderBy(F.col("ts").desc(), F.col("scan_id")).limit(k)


def latest_scan(log: DataFrame, tie_break: str) -> DataFrame:
    """The last write of every scan id, by (ts, tie_break).  An aggregation by sorting, since its buffer holds
    strings: each task sorts its rows by scan and sends one row per scan to the shuffle."""
    newest = F.max_by(F.struct(*[c for c in log.columns if c != "scan_id"]), F.struct("ts", tie_break))
    return log.groupBy("scan_id").agg(newest.alias("r")).select("scan_id", "r.*")


def suppress(findings: DataFrame, suppressions: DataFrame, on: Sequence[str]) -> DataFrame:
    """Findings that no suppression names.

    A small suppression table is broadcast by its measured size; otherwise AQE
    splits the partitions of keys with very many findings.
    """
    return findings.join(suppressions.select(*on).distinct(), list(on), "left_anti")


def compare_baseline(current: DataFrame, baseline: DataFrame) -> DataFrame:
    """Every finding key of either run as new, fixed or same.

    One aggregation over the union; with duplicates already merged on the map
    side there is no join that a hot key could skew.
    """
    key = ["file_path", "rule_id", "line_number"]
    runs = current.select(*key, F.lit(1).alias("now"), F.lit(0).alias("then")).unionByName(
        baseline.select(*key, F.lit(0).alias("now"), F.lit(1).alias("then")))
    status = (F.when(F.col("now") > F.col("then"), "new").when(F.col("now") < F.col("then"), "fixed").otherwise("same"))
    return runs.groupBy(*key).agg(F.max("now").alias("now"), F.max("then").alias("then")).select(*key, status.alias("status"))
