"""The scan store: an append-only log with a view of the latest write."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.findings import latest_scan


def append_scans(scans: DataFrame, path: str) -> None:
    """Add rows (scan_id, ts, seq, ...) to the log, in one folder per day."""
    scans.withColumn("day", F.to_date("ts")).write.mode("append").partitionBy("day").parquet(path)


def read_latest(spark: SparkSession, path: str) -> DataFrame:
    """The latest row of every scan id."""
    return latest_scan(spark.read.parquet(path).drop("day"), "seq")


def batch_writer(path: str) -> Callable[[DataFrame, int], None]:
    """For ``foreachBatch``: each micro-batch has its own folder, so a batch that
    runs again replaces its rows."""
    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")
    return write


# --- latest view in buckets ------------------------------------------------------------

def _manifests(spark: SparkSession, path: str) -> DataFrame | None:
    """All commits as (batch_id, bucket, version), or None before the first."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/commits")
    if not folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder):
        return None
    return spark.read.schema("bucket int, version long, batch_id long").parquet(f"{path}/commits")


def _current(spark: SparkSession, path: str) -> tuple[int, dict[int, int]]:
    """The last batch and the version of every bucket; the list is as long as there are buckets."""
    commits = _manifests(spark, path)
    if commits is None:
        return -1, {}
    last = commits.agg(F.max("batch_id")).first()[0]
    rows = commits.where(F.col("batch_id") == last).collect()
    return last, {r.bucket: r.version for r in rows if r.bucket >= 0}


def last_commit(spark: SparkSession, path: str) -> int:
    """Number of the last batch that a store has taken in, -1 if none."""
    return _current(spark, path)[0]


def _paths(path: str, versions: dict[int, int]) -> list[str]:
    return [f"{path}/data/version={v}/bucket={b}" for b, v in sorted(versions.items())]


def upsert_writer(path: str, buckets: int = 64, key: str = "scan_id", order: tuple[str, ...] = ("ts", "seq")) -> Callable[[DataFrame, int], None]:
    """For ``foreachBatch``: keeps the latest row of every key, in hash buckets.

    A batch rewrites the buckets that its keys fall into, next to the old ones, and then commits: one small
    file lists the version of every bucket.  Readers follow the last such file, so they see a batch wholly or not at all; a batch
    that runs again finds its commit and changes nothing, and one that failed before it overwrites what it left.
    Equal keys go by ``order``; rows without a key are left out.
    """
    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        last, versions = _current(spark, path)
        if batch_id <= last:
            return
        number = F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")
        new = batch.where(F.col(key).isNotNull()).withColumn("bucket", number).persist()
        touched = [r.bucket for r in new.select("bucket").distinct().collect()]
        old = _paths(path, {b: v for b, v in versions.items() if b in touched})
        rows = new
        if old:
            # Only the touched buckets are read.
            rows = new.unionByName(spark.read.schema(batch.schema).parquet(*old).withColumn("bucket", number))
        columns = [c for c in rows.columns if c not in (key, "bucket")]
        latest = rows.groupBy("bucket", key).agg(F.max_by(F.struct(*columns), F.struct(*order)).alias("row"))
        latest.select(key, "row.*", "bucket").repartition(buckets, "bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/data/version={batch_id}")
        new.unpersist()
        versions = versions | dict.fromkeys(touched, batch_id)
        listed = [(b, v) for b, v in versions.items()] or [(-1, batch_id)]
        # One file, moved into place as a whole when the job commits.
        spark.createDataFrame(listed, "bucket int, version long").coalesce(1).write.mode("overwrite").parquet(f"{path}/commits/batch_id={batch_id}")
    return write


def read_latest_view(spark: SparkSession, path: str, schema) -> DataFrame:
    """The latest row of every key, as of the last commit."""
    _, versions = _current(spark, path)
    if not versions:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(*_paths(path, versions))
