"""JSON export of scan summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import json_value


def summary_json(**fields: Column) -> Column:
    """An object with two-space indentation, fields in the given order."""
    lines = [F.concat(F.lit(f'  "{name}": '), value) for name, value in fields.items()]
    return F.concat(F.lit("{\n"), F.concat_ws(",\n", *lines), F.lit("\n}"))


def export_json(scans: DataFrame) -> DataFrame:
    """(scan_id, json) for scans with scan_id, type, n_findings and ts."""
    stamp = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
    return scans.select("scan_id", summary_json(
        id=json_value(F.col("scan_id")), type=json_value(F.col("type")),
        findings=F.col("n_findings").cast("string"), timestamp=json_value(stamp),
    ).alias("json"))


def write_json(exported: DataFrame, path: str) -> None:
    """One folder ``scan_id=<id>`` per scan with its JSON text."""
    exported.select("scan_id", "json").write.mode("overwrite").partitionBy("scan_id").text(path)
