"""Static analysis of source code."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import finding_id, snippet
from ..rules import CODE_RULES, CodeRule
from .matching import gate, locate
from .secrets import patch_path, uncovered


def _attribute(rules: Sequence[CodeRule], name: str) -> Column:
    """A rule's attribute by rule number, from a literal array (no join)."""
    values = F.array(*[F.lit(getattr(r, name)).cast("string") for r in rules])
    return F.element_at(values, F.col("rule_no") + 1)


def code_scan(files: DataFrame, rules: Sequence[CodeRule] = CODE_RULES, with_snippet: bool = True,
              keep: Sequence[str] = ()) -> DataFrame:
    """Findings of the code rules: one per (file, rule, line).

    ``files`` has scan_id, file_path, language and code.  Several matches of a
    rule on a line are one finding, which the locate step gives without a
    shuffle.  ``rule_order`` and ``line_number`` restore the report order.
    ``keep`` names further columns of ``files`` to carry along.
    """
    source = files.select("scan_id", "file_path", *keep, "code",
                          F.lower(F.coalesce("language", F.lit("python"))).alias("__language"))
    hits = locate(source, rules, language="__language", keep_lines=with_snippet)
    found = hits.select(
        "scan_id",
        "file_path",
        *keep,
        _attribute(rules, "rule_id").alias("rule_id"),
        F.col("rule_no").alias("rule_order"),
        F.col("line_number"),
        *[_attribute(rules, a).alias(a) for a in
          ("title", "severity", "category", "description", "remediation", "cwe_id", "owasp_category")],
        *([snippet(F.col("lines"), F.col("line_number")).alias("code_snippet")] if with_snippet else []),
    )
    return found.withColumn("finding_id", finding_id(F.col("rule_id"), F.col("file_path"), F.col("line_number")))


def rule_apply(files: DataFrame, rules: Sequence[CodeRule] = CODE_RULES) -> DataFrame:
    """Which rules match which files, without locating the matches."""
    source = files.withColumn("language", F.lower(F.coalesce("language", F.lit("python"))))
    return gate(source, rules, language="language").select(
        "scan_id", "file_path", _attribute(rules, "rule_id").alias("rule_id"))


def rules_for_language(language: Column, rules: Sequence[CodeRule] = CODE_RULES) -> Column:
    """Ids of the rules that apply to a language, in rule order."""
    tests = [
        F.lit(r.rule_id) if "any" in r.languages else F.when(language.isin(*r.languages), F.lit(r.rule_id))
        for r in rules
    ]
    return F.filter(F.array(*tests), lambda r: r.isNotNull())


def static_review(files: DataFrame, rules: Sequence[CodeRule] = CODE_RULES) -> DataFrame:
    """Per file: the number of findings and their ids, in report order.

    The group is one file, that is one row of the input, so what is collected
    is bounded by a single text.  Files without findings come from a null row.
    """
    found = code_scan(files, rules, with_snippet=False).select(
        "scan_id", "file_path", F.struct("rule_order", "line_number", "finding_id").alias("f"))
    none = files.select("scan_id", "file_path", F.lit(None).cast(found.schema["f"].dataType).alias("f"))
    return found.unionByName(none).groupBy("scan_id", "file_path").agg(
        F.count("f").alias("static_count"),
        F.transform(F.array_sort(F.collect_list("f")), lambda f: f["finding_id"]).alias("static_findings"),
    )


def deduplicate(findings: DataFrame) -> DataFrame:
    """First finding per (scan, path, rule, line), for findings that come from
    several runs.  Rows with the same key are equal, so which one stays does not
    matter and the duplicates already go on the map side."""
    return findings.dropDuplicates(["scan_id", "file_path", "rule_id", "line_number"])


REQUEST = ("scan_id", "file_path", "line_number", "id", "title", "description", "severity", "category", "code_snippet",
           "remediation", "cwe_id", "owasp_category")


def code_request(files: DataFrame, external: DataFrame, finished: DataFrame, with_snippet: bool = True) -> DataFrame:
    """Code findings of requests, each with its ``scanner``: Bearer's where it ``finished`` a file, the code rules' elsewhere.

    ``external`` is a parsed report; a path that it names is that of a temporary copy and is replaced.
    """
    columns = [c for c in REQUEST if with_snippet or c != "code_snippet"]
    own = code_scan(uncovered(files, finished), with_snippet=with_snippet).withColumnRenamed("finding_id", "id")
    bearer = patch_path(external, only_if_reported=True)
    return (own.select(*columns, F.lit("built-in").alias("scanner"))
            .unionByName(bearer.select(*columns, F.lit("bearer").alias("scanner"))))
