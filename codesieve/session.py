"""Session helpers: settings, the shared folder, and spreading small inputs."""

from __future__ import annotations

import os
import tempfile
import uuid
from functools import cache

from pyspark.sql import DataFrame, SparkSession

# Settings the operators are written for.  AQE sizes the shuffle partitions and
# splits skewed join partitions at run time; broadcasts stay behind Spark's own
# size check (spark.sql.autoBroadcastJoinThreshold).
SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    # Call-site capture on every Column costs more than the plans themselves.
    "spark.python.sql.dataFrameDebugging.enabled": "false",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def local_session(cores: str = "*", app: str = "codesieve", **extra: str) -> SparkSession:
    """A session for tests and benchmarks on one machine."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName(app)
    n = os.cpu_count() if cores == "*" else int(cores)
    conf = {**SETTINGS, "spark.sql.shuffle.partitions": str(n), "spark.driver.memory": "8g", **extra}
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


@cache
def _local_folder() -> str:
    return tempfile.mkdtemp(prefix="codesieve-")


def shared_folder(spark: SparkSession, purpose: str) -> str:
    """A new folder below the one the cluster names in ``spark.checkpoint.dir``.

    Only a local session may fall back to a temporary folder of this machine: on
    a cluster the executors could not see it.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        base = _local_folder()
    return f"{base.rstrip('/')}/{purpose}-{uuid.uuid4().hex}"


def written(df: DataFrame, purpose: str) -> DataFrame:
    """``df`` as a table in the shared folder, for results that are read more than
    once.  It survives the loss of executors, and its lineage ends there."""
    path = shared_folder(df.sparkSession, purpose)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


# Only inputs of fewer partitions than this (a few GB at the default split size)
# are ever shuffled just to use more cores.
SPREAD_BELOW = 32


def few_partitions(df: DataFrame) -> bool:
    """Whether a scan is small and comes in fewer partitions than there are cores."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.rdd.getNumPartitions() < min(cores, SPREAD_BELOW)


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Use more cores on a small input that arrives in very few partitions.

    Tables of many files are returned as they are, so nothing is shuffled at
    scale.  ``keys`` should be unique per row.  Call it on a scan only: it asks
    for the plan's partition count.
    """
    if not few_partitions(df):
        return df
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(min(cores, SPREAD_BELOW) * 4, *keys)


# Rows of a narrow table that one task derives texts from.
DEALT_ROWS = 100_000


def dealt(df: DataFrame, *keys: str) -> DataFrame:
    """A narrow table whose rows become much larger ones (manifests, advisories), dealt to tasks by their number.

    A row group of such a table holds a million rows in a few MB, so the size of its files says nothing about the work.
    Rows are counted from the files' footers, and only the few columns of the scan are shuffled.
    """
    tasks = -(-df.count() // DEALT_ROWS)
    if few_partitions(df):
        tasks = max(tasks, min(df.sparkSession.sparkContext.defaultParallelism, SPREAD_BELOW) * 4)
    return df.repartition(tasks, *keys) if tasks > 1 else df
