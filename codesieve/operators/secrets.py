"""Secrets in texts, by token format and by entropy."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import mask_tail, sha1_short, shannon_entropy
from ..rules import SECRET_RULES, SecretRule
from .matching import hit_values, locate


def _rule_value(rules: Sequence[SecretRule], name: str) -> Column:
    return F.element_at(F.array(*[F.lit(getattr(r, name)) for r in rules]), F.col("rule_no") + 1)


def _secret_hits(files: DataFrame, rules: Sequence[SecretRule]) -> DataFrame:
    hits = locate(files.select("scan_id", "file_path", "code"), rules)
    return hits.select(
        "scan_id", "file_path", "rule_no", "line_number",
        F.explode(F.array_distinct(hit_values(F.col("line_marked")))).alias("value"),
    )


def secret_scan(files: DataFrame, rules: Sequence[SecretRule] = SECRET_RULES,
                min_entropy: float | None = None) -> DataFrame:
    """One row per (file, rule, line, value); only the masked value leaves.

    Rules with a ``min_entropy`` report a value only if its entropy in bits per
    character reaches it; the argument replaces those thresholds.
    """
    threshold = _rule_value(rules, "min_entropy")
    if min_entropy is not None:
        threshold = F.when(threshold > 0, F.lit(float(min_entropy))).otherwise(F.lit(0.0))
    value, entropy = F.col("value"), shannon_entropy(F.col("value"))
    found = _secret_hits(files, rules).where((threshold == 0) | (entropy >= threshold))
    return found.select(
        "scan_id", "file_path", "line_number",
        _rule_value(rules, "secret_type").alias("type"),
        _rule_value(rules, "description").alias("description"),
        mask_tail(value).alias("masked_value"),
        _rule_value(rules, "severity").alias("severity"),
        _rule_value(rules, "confidence").alias("confidence"),
        F.concat(
            F.lit("sec-"), _rule_value(rules, "rule_id"), F.lit("-"),
            sha1_short(F.concat_ws(":", "file_path", F.col("line_number").cast("string"), value)),
        ).alias("id"),
        F.lit("built-in").alias("scanner"),
    )


def entropy_candidates(files: DataFrame, rules: Sequence[SecretRule] = SECRET_RULES) -> DataFrame:
    """Candidate strings of the entropy rules with their entropy, masked."""
    candidates = [r for r in rules if r.min_entropy > 0]
    return _secret_hits(files, candidates).select(
        "scan_id", "file_path", "line_number", mask_tail(F.col("value")).alias("masked_value"),
        F.length("value").alias("n_chars"), shannon_entropy(F.col("value")).alias("entropy"),
    )


def secret_union(primary: DataFrame, supplement: DataFrame) -> DataFrame:
    """Results of the primary scanner followed by the supplementary one's; kept
    as they are, without deduplication across scanners."""
    return primary.unionByName(supplement)


def scanner_precedence(external: DataFrame, built_in: DataFrame, successful_runs: DataFrame) -> DataFrame:
    """External results where the tool ran, built-in results elsewhere.

    ``successful_runs`` names (scan_id, file_path) of every file the tool
    finished, also those without findings.
    """
    done = successful_runs.select("scan_id", "file_path").distinct()
    return external.unionByName(built_in.join(done, ["scan_id", "file_path"], "left_anti"))


def uncovered(files: DataFrame, successful_runs: DataFrame) -> DataFrame:
    """The files that the tool has not finished: only these need a scan of our own.

    The join comes before the scan, so covered texts are never searched.  Null paths are never covered.
    """
    return files.join(successful_runs.select("scan_id", "file_path").distinct(), ["scan_id", "file_path"], "left_anti")


def patch_path(findings: DataFrame, only_if_reported: bool = False) -> DataFrame:
    """Replace the path a tool reported (of a temporary copy) by the original
    ``file_path``; with ``only_if_reported``, only where it named one."""
    path = F.when(F.coalesce("reported_path", F.lit("")) != "", F.col("file_path")) if only_if_reported \
        else F.col("file_path")
    return findings.withColumn("file_path", path).drop("reported_path")


def secrets_request(files: DataFrame, external: DataFrame, finished: DataFrame, supplement: DataFrame) -> DataFrame:
    """All secrets of requests, each with its ``scanner``: gitleaks where it ``finished`` a file, built-in rules elsewhere,
    followed by what trufflehog found.

    ``external`` and ``supplement`` are parsed reports; their paths of temporary copies are replaced.
    """
    built_in = secret_scan(uncovered(files, finished))
    tagged = [patch_path(df).withColumn("scanner", F.lit(name)).select(*built_in.columns)
              for df, name in ((external, "gitleaks"), (supplement, "trufflehog"))]
    return secret_union(built_in.unionByName(tagged[0]), tagged[1])
