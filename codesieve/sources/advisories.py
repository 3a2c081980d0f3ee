"""Vulnerability records: OSV bulk dumps and NVD responses."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas


def parse_osv(records: DataFrame, column: str = "record") -> DataFrame:
    """JSON texts in OSV form to the advisories table."""
    # Through a generator: a filter on a parsed column would be pushed below the
    # projection and every text parsed twice.
    return records.select(F.inline(F.array(F.from_json(column, schemas.ADVISORY)))).where("id is not null")


def read_osv(spark: SparkSession, path: str) -> DataFrame:
    """An OSV dump stored as JSON lines."""
    return parse_osv(spark.read.text(path).withColumnRenamed("value", "record"))


def parse_nvd(responses: DataFrame, column: str = "response") -> DataFrame:
    """NVD API v2 responses to (id, summary, published, modified).

    The summary is the first English description, or empty; responses without a
    record give no row.
    """
    first = F.slice(F.from_json(column, schemas.NVD)["vulnerabilities"], 1, 1)
    cve = responses.select(F.inline(F.coalesce(first, F.array()))).where("cve is not null")
    english = F.filter("cve.descriptions", lambda d: d["lang"] == "en")
    return cve.select(
        F.col("cve.id").alias("id"),
        F.coalesce(F.get(english, F.lit(0))["value"], F.lit("")).alias("summary"),
        F.col("cve.published").alias("published"),
        F.col("cve.lastModified").alias("modified"),
    )
