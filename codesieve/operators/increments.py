"""Figures that are kept up to date by what arrives, without reading findings again.

Every batch is reduced to counts per scan.  Counts of one sending of a scan add up over batches, and a later sending
replaces the earlier: what the scan stood for before is cancelled.  The change to the figures of the dashboard
goes into a log of one row per batch; the dashboard is the sum of that log.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.severity import LEVELS
from ..sinks.store import last_commit, read_latest_view, upsert_writer

_STATE = "scan_id string, seq long, " + ", ".join(f"{level} long" for level in LEVELS) + ", n long"
_FIGURES = ("scans", "critical", "warnings", "clean")
_DELTAS = ", ".join(f"{f} long" for f in _FIGURES) + ", batch_id long"


def _figures(prefix: str) -> dict[str, Column]:
    """What one scan adds to the dashboard; nothing if there is no such scan."""
    c = {level: F.col(f"{prefix}.{level}") for level in LEVELS}
    severe = c["critical"] + c["high"]
    there, none = F.col(f"{prefix}.seq").isNotNull(), F.lit(0).cast("long")
    parts = {"scans": F.lit(1).cast("long"), "critical": severe, "warnings": F.when(severe == 0, c["medium"]), "clean": F.when(F.col(f"{prefix}.n") == 0, F.lit(1).cast("long"))}
    return {name: F.coalesce(F.when(there, part), none) for name, part in parts.items()}


def stats_writer(path: str, buckets: int = 64) -> Callable[[DataFrame, int], None]:
    """For ``foreachBatch``: keeps counts per scan and a log of changes from batches of (scan_id, seq, severity).

    A row with a null severity says that the scan was sent, with no finding in this row.  ``seq`` numbers the sendings of a scan.  Rows of
    an older sending than the one that is known change nothing.  The log of a batch is written before its
    counts are committed, and read only if they are; a batch that runs again replaces it or changes nothing.
    """
    upsert = upsert_writer(f"{path}/scans", buckets, order=("seq", "n"))

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        if batch_id <= last_commit(spark, f"{path}/scans"):
            return
        counts = batch.where("scan_id is not null and seq is not null").groupBy("scan_id", "seq").agg(
            *[F.count_if(F.col("severity") == level).alias(level) for level in LEVELS], F.count("severity").alias("n"))
        newest = counts.groupBy("scan_id").agg(F.max_by(F.struct("seq", *LEVELS, "n"), "seq").alias("sent"))
        known = read_latest_view(spark, f"{path}/scans", _STATE).select("scan_id", F.struct("seq", *LEVELS, "n").alias("old"))
        both = newest.join(known, "scan_id", "left").where(F.col("old").isNull() | (F.col("sent.seq") >= F.col("old.seq")))
        same = F.coalesce(F.col("sent.seq") == F.col("old.seq"), F.lit(False))
        now = F.struct(F.col("sent.seq").alias("seq"), *[
            F.when(same, F.col(f"sent.{c}") + F.col(f"old.{c}")).otherwise(F.col(f"sent.{c}")).alias(c) for c in (*LEVELS, "n")])
        # The store is read while it is written to, so the batch's new counts are settled first.
        changed = both.select("scan_id", "old", now.alias("now")).persist()
        before, after = _figures("old"), _figures("now")
        delta = changed.agg(*[F.coalesce(F.sum(after[f] - before[f]), F.lit(0).cast("long")).alias(f) for f in _FIGURES])
        delta.coalesce(1).write.mode("overwrite").parquet(f"{path}/changes/batch_id={batch_id}")
        upsert(changed.select("scan_id", "now.*"), batch_id)
        changed.unpersist()
    return write


def dashboard(spark: SparkSession, path: str) -> DataFrame:
    """The figures of :func:`summaries.dashboard_stats`, from the log of changes of all committed batches."""
    last = last_commit(spark, f"{path}/scans")
    log = spark.createDataFrame([], _DELTAS) if last < 0 else spark.read.schema(_DELTAS).parquet(f"{path}/changes")
    return log.where(F.col("batch_id") <= last).agg(*[F.coalesce(F.sum(f), F.lit(0).cast("long")).alias(f) for f in _FIGURES])


def scan_counts(spark: SparkSession, path: str) -> DataFrame:
    """The figures of :func:`summaries.severity_summary`, of the latest sending of every scan."""
    return read_latest_view(spark, f"{path}/scans", _STATE).select("scan_id", *LEVELS)
