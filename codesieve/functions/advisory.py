"""Scalar rules over advisory records."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NO_SUMMARY = "No summary available"
_CVE_ID = r"(?i)^CVE-[0-9]{4}-[0-9]{4,}\z"


def valid_cve_id(cve_id: Column) -> Column:
    return F.coalesce(cve_id.rlike(_CVE_ID), F.lit(False))


def cve_aliases(aliases: Column) -> Column:
    return F.filter(aliases, lambda a: F.startswith(a, F.lit("CVE-")))


def cve_id_pick(aliases: Column, advisory_id: Column) -> Column:
    """First CVE alias, else the advisory's own id."""
    return F.coalesce(F.get(cve_aliases(aliases), F.lit(0)), advisory_id, F.lit("UNKNOWN"))


def reference_urls(references: Column, at_most: int | None = None) -> Column:
    """Non-empty reference URLs in source order."""
    urls = F.filter(F.transform(references, lambda r: r["url"]), lambda u: u.isNotNull() & (u != ""))
    urls = F.coalesce(urls, F.array().cast("array<string>"))
    return F.slice(urls, 1, at_most) if at_most else urls


def affected_names(affected: Column) -> Column:
    """``ecosystem/name`` of each affected package that has a name."""
    named = F.filter(affected, lambda a: F.coalesce(a["package"]["name"], F.lit("")) != "")
    names = F.transform(named, lambda a: F.concat_ws(
        "/", F.nullif(a["package"]["ecosystem"], F.lit("")), a["package"]["name"]))
    return F.coalesce(names, F.array().cast("array<string>"))


def summary_or_default(summary: Column) -> Column:
    return F.coalesce(summary, F.lit(NO_SUMMARY))
