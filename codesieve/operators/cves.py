"""CVE lookups over advisory tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.advisory import affected_names, reference_urls, summary_or_default, valid_cve_id
from ..functions.severity import cve_severity_label, first_score
from .skew import spread_join


def check_requests(requests: DataFrame) -> DataFrame:
    """Requests with ``error`` set for ids that are no CVE ids."""
    invalid = F.concat(F.lit("Invalid CVE ID format: "), F.coalesce("cve_id", F.lit("")))
    return requests.withColumn("error", F.when(~valid_cve_id(F.col("cve_id")), invalid))


def cve_sources(osv: DataFrame, nvd: DataFrame) -> DataFrame:
    """One record per CVE: the OSV record, else the NVD one.

    Of records that share an id, in any case, the one that was modified last counts.  Records that OSV has are dropped
    from NVD's with an anti join before both are put together.
    """
    from_osv = osv.where(valid_cve_id(F.col("id"))).select(
        F.upper("id").alias("cve_id"),
        F.lit("osv").alias("source"),
        "summary", "published", "modified",
        cve_severity_label(F.struct("severity", "database_specific")).alias("severity"),
        first_score(F.col("severity")).alias("cvss_score"),
        reference_urls(F.col("references"), 8).alias("references"),
        affected_names(F.col("affected")).alias("affected"),
    )
    none = F.array().cast("array<string>")
    from_nvd = nvd.select(
        F.upper("id").alias("cve_id"), F.lit("nvd").alias("source"), "summary", "published", "modified",
        F.lit("UNKNOWN").alias("severity"), F.lit(None).cast("double").alias("cvss_score"),
        none.alias("references"), none.alias("affected"),
    )
    from_osv, from_nvd = _newest(from_osv), _newest(from_nvd)
    return from_osv.unionByName(from_nvd.join(from_osv.select("cve_id"), "cve_id", "left_anti"))


def _newest(records: DataFrame) -> DataFrame:
    """One record per CVE: the last modified, of equals the last published, then the last by summary."""
    fields = [c for c in records.columns if c != "cve_id"]
    newest = F.max_by(F.struct(*fields), F.struct("modified", "published", "summary"))
    return records.groupBy("cve_id").agg(newest.alias("r")).select("cve_id", "r.*").select(*records.columns)


def explain_records(requests: DataFrame, osv: DataFrame, nvd: DataFrame) -> DataFrame:
    """Every request with the record of its CVE.

    Invalid ids get an ``error``; an id that no table knows gets defaults.
    ``requests`` has request_id and cve_id.  Many requests may name the same
    CVE, so the join deals the requests of such a CVE to several tasks.
    """
    checked = check_requests(requests).withColumns({
        "requested": F.col("cve_id"),
        # Invalid ids get keys of their own, which match nothing and spread evenly.
        "cve_id": F.when(F.col("error").isNull(), F.upper("cve_id")).otherwise(
            F.concat(F.lit("invalid "), F.col("request_id").cast("string"))),
    })
    joined = spread_join(checked, cve_sources(osv, nvd), on=["cve_id"], spread_by=["request_id"]).withColumn(
        "cve_id", F.when(F.col("error").isNull(), F.col("cve_id")))
    none = F.array().cast("array<string>")
    return joined.withColumns({
        "source": F.coalesce("source", F.lit("none")),
        "severity": F.coalesce("severity", F.lit("UNKNOWN")),
        "references": F.coalesce("references", none),
        "affected": F.coalesce("affected", none),
    })


def explanation(records: DataFrame) -> DataFrame:
    """The eight reported fields, with the summary's default."""
    return records.select(
        "request_id", "cve_id", summary_or_default(F.col("summary")).alias("summary"), "published", "modified",
        "severity", "cvss_score", "references", "affected", "error")
