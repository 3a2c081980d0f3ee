"""Scans on Structured Streaming.

The scanners are stateless column expressions, so they run on a stream as they
do on a table.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.findings import SCAN_TYPES as STEPS
from ..operators.findings import scan_full

# The messages shown when a step starts.
START_MESSAGES = {
    "secrets": "Scanning for secrets and credentials...",
    "code": "Running static analysis...",
    "owasp": "Running OWASP Top 10 checks...",
}
_PAYLOAD = "code STRING, language STRING, scan_types ARRAY<STRING>, __corrupt STRING"


def parse_requests(messages: DataFrame) -> DataFrame:
    """(scan_id, ts, payload) messages to scan requests.

    Missing fields get their defaults; a payload that is no JSON object sets
    ``error`` and leaves nothing to scan.
    """
    parsed = F.from_json("payload", _PAYLOAD, {"columnNameOfCorruptRecord": "__corrupt"})
    rows = messages.withColumn("__p", parsed)
    bad = F.col("__p").isNull() | F.col("__p.__corrupt").isNotNull()
    return rows.select(
        "scan_id", "ts",
        F.concat(F.lit("ws-scan."), F.coalesce("__p.language", F.lit("python"))).alias("file_path"),
        F.coalesce("__p.language", F.lit("python")).alias("language"),
        F.when(~bad, F.coalesce("__p.code", F.lit(""))).alias("code"),
        F.coalesce("__p.scan_types", F.array(*[F.lit(s) for s in STEPS])).alias("scan_types"),
        F.when(bad, "invalid request").alias("error"),
    )


def error_messages(requests: DataFrame) -> DataFrame:
    """One error message per request that cannot be read."""
    failed = requests.where(F.col("error").isNotNull())
    return failed.select("scan_id", F.to_json(F.struct("error", "scan_id")).alias("message"))


def scan_progress(requests: DataFrame) -> DataFrame:
    """The progress events of every request, from its list of scan types.

    Each known step has a start and an end; names that are not known count in
    the total but give no event.
    """
    types = F.col("scan_types")
    total = F.size(types).cast("double")
    present = {s: F.array_contains(types, s) for s in STEPS}
    done = F.lit(0)
    events: list[Column] = []

    def event(step: str, phase: str, pct: Column, message: str | None, when: Column | None) -> None:
        made = F.struct(F.lit(len(events)).alias("seq"), F.lit(step).alias("step"), F.lit(phase).alias("phase"),
                        pct.cast("int").alias("progress"), F.lit(message).cast("string").alias("message"))
        events.append(made if when is None else F.when(when, made))

    def share(count: Column) -> Column:
        return F.when(total > 0, (count / total * 90).cast("int") + 5)

    for step in STEPS:
        start = F.lit(10) if step == "secrets" else share(done)
        event(step, "start", start, START_MESSAGES[step], present[step])
        done = done + F.when(present[step], 1).otherwise(0)
        event(step, "end", F.lit(95) if step == "owasp" else share(done), None, present[step])
    event("complete", "end", F.lit(100), "Scan complete", None)
    return requests.select("scan_id", F.explode(F.filter(F.array(*events), lambda e: e.isNotNull())).alias("e")).select(
        "scan_id", "e.*")


def step_messages(requests: DataFrame, findings: DataFrame) -> DataFrame:
    """What each finished step reports: the number of its findings, or of passed
    checks.

    ``findings`` comes from :func:`scan_stream`.  Requests without findings get
    zero rows from a union; distinct checks are counted as bits, so every task
    sends one row per request.
    """
    check = F.substring_index(F.substring_index("rule_id", ":", 1), "A", -1).try_cast("int")
    bit = F.when(F.col("kind") == "owasp", F.pow(F.lit(2), check - 1).cast("int"))
    found = findings.select("scan_id", "kind", bit.alias("bit"), F.lit(None).cast("array<string>").alias("types"))
    asked = requests.select("scan_id", F.lit(None).cast("string").alias("kind"), F.lit(0).alias("bit"),
                            F.col("scan_types").alias("types"))
    counts = found.unionByName(asked).groupBy("scan_id").agg(
        F.count_if(F.col("kind") == "secrets").alias("secrets"), F.count_if(F.col("kind") == "code").alias("code"),
        F.bit_count(F.bit_or("bit")).alias("failed"),
        *[F.max(F.array_contains("types", s)).alias(f"asked_{s}") for s in STEPS])
    text = lambda c: c.cast("string")
    # The wording of the messages.
    messages = {
        "secrets": F.concat(F.lit("Found "), text(F.col("secrets")), F.lit(" secret(s)")),
        "code": F.concat(F.lit("Found "), text(F.col("code")), F.lit(" vulnerability/ies")),
        "owasp": F.concat(F.lit("OWASP: "), text(10 - F.col("failed")), F.lit("/10 passed")),
    }
    steps = F.array(*[F.when(F.col(f"asked_{s}"), F.struct(F.lit(s).alias("step"), m.alias("message"))) for s, m in messages.items()])
    return counts.select("scan_id", F.explode(F.filter(steps, lambda s: s.isNotNull())).alias("s")).select("scan_id", "s.*")


def scan_stream(requests: DataFrame) -> DataFrame:
    """Findings of every arriving request, for the scan types it asks for."""
    return scan_full(requests, scan_types="scan_types")


def first_findings(findings: DataFrame, watermark: str = "1 hour", time: str = "ts") -> DataFrame:
    """Findings without re-sent ones, remembered for the length of the watermark."""
    key = ["scan_id", "file_path", "rule_id", "line_number"]
    if findings.isStreaming:
        return findings.withWatermark(time, watermark).dropDuplicatesWithinWatermark(key)
    return findings.dropDuplicates(key)


# State lives in RocksDB, so it may outgrow the memory, and a checkpoint holds what changed instead of a whole copy.
DURABLE_STATE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
}


def keep_state_durable(spark: SparkSession) -> None:
    """Set what streams with state need; a stream that has a checkpoint keeps the store it was started with."""
    for key, value in DURABLE_STATE.items():
        spark.conf.set(key, value)


def write_stream(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append to parquet files, exactly once; runs until the input is used up."""
    keep_state_durable(stream.sparkSession)
    return (
        stream.writeStream.format("parquet").outputMode("append")
        .option("path", path).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )


def write_batches(stream: DataFrame, write: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Hand every micro-batch to ``write`` with its number; runs until the input is used up."""
    keep_state_durable(stream.sparkSession)
    return (stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start())


def read_table_stream(spark: SparkSession, folder: str, file_name: str, schema: str,
                      files_per_batch: int = 1000) -> DataFrame:
    """The parquet files of a folder with such a name (may have wildcards) as a stream.  A table may be one file or a
    folder of files: given as a pattern, Spark takes either."""
    pattern = file_name if "*" in file_name else f"{file_name[:-1]}[{file_name[-1]}]"
    return (
        spark.readStream.schema(schema)
        .option("maxFilesPerTrigger", files_per_batch).parquet(f"{folder}/{pattern}")
    )
