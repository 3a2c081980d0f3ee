"""Many small texts in few files, with an index of byte ranges.

Reports, exports and transcripts come as ordered lines of many scans.  One folder for each scan would be millions of
files; here the lines of all scans are cut into ranges of their order, each range is one file, and an index tells for
every scan in which files it lies and at which bytes.  A scan that holds most lines spans several files.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import SPREAD_BELOW, written

# Bytes that a file of a range holds, more or less; a reader holds a whole file.
FILE_BYTES = 16 << 20
# Bytes of text that one task writes of files in parts, more or less.
PART_BYTES = 32 << 20


def write_ranges(lines: DataFrame, path: str, value: str, order: Sequence[str] = (), key: str = "scan_id") -> None:
    """Write column ``value`` of all lines, each ended by a newline, sorted by ``key`` and ``order``.

    Below ``path``, ``text`` has one file of about :data:`FILE_BYTES` per range, and ``index`` rows
    (key, piece, range, start, n_bytes); ``piece`` counts the files of a key.  Lines with a null value are left out; those
    without a key are found under null.
    """
    by = [key, *order]
    placed = written(lines.where(F.col(value).isNotNull()).select(*by, F.col(value).alias("__value")).repartitionByRange(*by).sortWithinPartitions(*by)
                     .select(F.col(key).alias("key"), F.spark_partition_id().alias("range"), F.monotonically_increasing_id().alias("at"),
                             F.col("__value").alias("value")), "range-lines")
    # The rows of a sorted partition are cut into files by their place and the mean size of a line.
    row = F.col("at").bitwiseAND((1 << 33) - 1)
    sizes = placed.agg(F.count("*").alias("n"), F.sum(F.octet_length("value") + 1).alias("n_bytes"), F.max(row).alias("last")).first()
    rows = max(1, FILE_BYTES * sizes.n // max(1, sizes.n_bytes or 1))
    files = (sizes["last"] or 0) // rows + 1
    placed = placed.withColumn("range", (F.col("range") * files + F.floor(row / rows)).cast("int"))
    (placed.repartition("range").sortWithinPartitions("range", "at").select("range", "value")
     .write.mode("overwrite").partitionBy("range").text(f"{path}/text"))
    size = placed.groupBy("range", "key").agg(F.min("at").alias("at"), F.sum(F.octet_length("value") + 1).cast("long").alias("n_bytes"))
    before = Window.partitionBy("range").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum("n_bytes").over(before), F.lit(0).cast("long"))
    piece = F.row_number().over(Window.partitionBy("key").orderBy("range")) - 1
    (size.withColumn("start", start).withColumn("piece", piece).select("key", "piece", "range", "start", "n_bytes")
     .repartitionByRange("key").sortWithinPartitions("key", "piece").write.mode("overwrite").parquet(f"{path}/index"))


def write_parts(lines: DataFrame, path: str, value: str, file: str, order: Sequence[str]) -> None:
    """Write column ``value`` of all lines, each ended by a newline, to one folder ``<file>=<its value>`` for each file.

    Lines are cut into ranges of ``file`` and ``order``, so a file that holds most lines is many tasks' work, and no task's grows with the
    input.  The files in a folder, in name order, are the parts of the text (``sources.files.scan_directory`` takes them so with ``in_parts``).
    """
    by = [file, *order]
    n_bytes = lines.agg(F.sum(F.octet_length(value) + 1).alias("n")).first()["n"] or 0
    tasks = max(-(-n_bytes // PART_BYTES), min(lines.sparkSession.sparkContext.defaultParallelism, SPREAD_BELOW))
    (lines.repartitionByRange(tasks, *by).sortWithinPartitions(*by).select(file, value)
     .write.partitionBy(file).text(path))


def read_index(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(f"{path}/index")


def read_texts(spark: SparkSession, path: str, keys: Sequence[str | None] | None = None) -> DataFrame:
    """(key, piece, text) for some keys, or for all; the pieces of a key in a row are its text.

    For given keys only the files that the index names are opened.
    """
    index = read_index(spark, path)
    files = spark.read.format("binaryFile")
    if keys is None:
        found = files.load(f"{path}/text").select("range", "content")
    else:
        index = index.where(F.col("key").isin([k for k in keys if k is not None]) | (F.col("key").isNull() if None in keys else F.lit(False)))
        ranges = [r["range"] for r in index.select("range").distinct().collect()]  # files that hold the asked keys
        if not ranges:
            return spark.createDataFrame([], "key string, piece int, text string")
        found = files.option("basePath", f"{path}/text").load([f"{path}/text/range={r}" for r in ranges]).select("range", "content")
    # A file meets all its places in one row, and the lambda binds its content: it is copied once and not for each place.
    places = index.groupBy("range").agg(F.collect_list(F.struct("key", "piece", "start", "n_bytes")).alias("places"))
    cut = lambda content, p: F.struct(p["key"].alias("key"), p["piece"].alias("piece"), F.substring(
        content, (p["start"] + 1).cast("int"), p["n_bytes"].cast("int")).cast("string").alias("text"))
    texts = F.transform(F.array("content"), lambda content: F.transform("places", lambda p: cut(content, p)))
    return places.join(found, "range").select(F.explode(F.element_at(texts, 1)).alias("t")).select("t.*")
