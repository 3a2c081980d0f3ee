"""Tables of source texts: submitted code, directories, languages, size cap."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import decode_utf8
from ..session import written

# File suffix of each language.
SUFFIXES = {
    ".py": "python", ".js": "javascript", ".ts": "typescript", ".java": "java", ".go": "go",
    ".php": "php", ".rb": "ruby", ".c": "c", ".cpp": "cpp",
}
DEFAULT_SIZE_CAP = 50 * 1024 * 1024


def language_of(path: Column) -> Column:
    """Language by file suffix, or null."""
    suffix = F.lower(F.regexp_extract(path, r"(\.[^./]+)$", 1))
    pairs = [F.lit(x) for item in SUFFIXES.items() for x in item]
    return F.try_element_at(F.create_map(*pairs), suffix)


def submitted_code(requests: DataFrame, for_secrets: bool = False) -> DataFrame:
    """Requests as a files table: language in lower case, python by default, and
    a stand-in path for texts that come without one (``<stdin>`` in a secret scan,
    else ``<stdin.language>``)."""
    language = F.lower(F.coalesce(F.nullif("language", F.lit("")), F.lit("python")))
    stand_in = F.lit("<stdin>") if for_secrets else F.concat(F.lit("<stdin."), language, F.lit(">"))
    path = F.coalesce(F.nullif("file_path", F.lit("")), stand_in)
    return requests.withColumns({"file_path": path, "language": language})


def decode_files(binary_files: DataFrame) -> DataFrame:
    """(path, content) to (file_path, language, code); invalid bytes are dropped."""
    return binary_files.select(
        F.col("path").alias("file_path"),
        F.coalesce(language_of(F.col("path")), F.lit("text")).alias("language"),
        decode_utf8(F.col("content")).alias("code"),
    )


def _listing(spark: SparkSession, root: str) -> DataFrame:
    return (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", "true")
        .option("ignoreCorruptFiles", "true")
        .option("ignoreMissingFiles", "true")
        .load(root)
    )


def read_directory(spark: SparkSession, root: str, size_cap: int | None = None) -> DataFrame:
    """Every readable file below ``root``, of those beyond ``size_cap`` none; :func:`oversize_files` tells which these are.

    The size test runs on the file listing, before any content is read.
    """
    files = _listing(spark, root)
    return decode_files(files if size_cap is None else files.where(F.col("length") <= size_cap))


def oversize_files(spark: SparkSession, root: str, size_cap: int = DEFAULT_SIZE_CAP) -> DataFrame:
    """The files that ``read_directory`` leaves out with that cap: file_path, n_bytes and the reason.  No content is read."""
    return _listing(spark, root).where(F.col("length") > size_cap).select(
        F.col("path").alias("file_path"), F.col("length").alias("n_bytes"), F.format_string("larger than %d bytes", F.lit(size_cap)).alias("reason"))


def _whole(part: Column) -> Column:
    """The file that a part belongs to: its folder."""
    return F.regexp_replace(part, "/[^/]*$", "")


def list_files(spark: SparkSession, root: str, in_parts: bool = False) -> DataFrame:
    """Every file below ``root`` as (file_path, n_bytes), as a table; no content is read.  Spark's file sources pass over empty files.

    ``in_parts``: a folder's files are the parts of one file, which goes by the folder's path and has their bytes in all.
    """
    listing = _listing(spark, root).select(F.col("path").alias("file_path"), F.col("length").alias("n_bytes"))
    if in_parts:
        listing = listing.groupBy(_whole(F.col("file_path")).alias("file_path")).agg(F.sum("n_bytes").alias("n_bytes"))
    return written(listing, "listing")


def _put_together(parts: DataFrame, listing: DataFrame, size_cap: int) -> DataFrame:
    """(path, length, content) of the listed files within the cap, their parts in name order; those with a part gone or changed are left out."""
    within = listing.where(F.col("n_bytes") <= size_cap).select(F.col("file_path").alias("path"), F.col("n_bytes").alias("length"))
    of = parts.select(_whole(F.col("path")).alias("path"), F.col("path").alias("part"), "content").join(within, "path")
    whole = of.groupBy("path", "length").agg(F.expr("listagg(content) WITHIN GROUP (ORDER BY part)").alias("content"))
    return whole.where(F.octet_length("content") == F.col("length"))


def scan_directory(spark: SparkSession, root: str, size_cap: int = DEFAULT_SIZE_CAP, listing: DataFrame | None = None,
                   in_parts: bool = False) -> DataFrame:
    """Every listed file with what became of it: (file_path, n_bytes, language, code, status, reason).

    ``status`` is ``text``, ``oversize`` (beyond the cap, never opened) or ``unreadable`` (listed, but gone or not to be read
    afterwards); code is null for the last two.  A listing that was taken before may be given.  Files are dealt to tasks by their bytes, with
    a charge for opening each (``spark.sql.files.maxPartitionBytes`` and ``openCostInBytes``), so neither millions of small files nor a few
    large ones make a long task.  Contents are read once and kept in the shared folder.

    ``in_parts``: a folder's files are the parts of one file (see :func:`list_files`), in name order, as several tasks have written them.
    The cap holds for the whole file; of one beyond it, parts that are within the cap may be opened, and are dropped.
    """
    listing = list_files(spark, root, in_parts) if listing is None else listing
    readable = _listing(spark, root).where(F.col("length") <= size_cap)
    if in_parts:
        readable = _put_together(readable, listing, size_cap)
    texts = written(readable.select(
        F.col("path").alias("file_path"), F.col("length").alias("n_bytes"), F.coalesce(language_of(F.col("path")), F.lit("text")).alias("language"),
        decode_utf8(F.col("content")).alias("code")), "texts")
    none = F.lit(None).cast("string")
    shape = lambda df, code, status, reason: df.select(
        "file_path", "n_bytes", F.coalesce(language_of(F.col("file_path")), F.lit("text")).alias("language"), code.alias("code"),
        F.lit(status).alias("status"), reason.alias("reason"))
    kept = shape(texts.join(listing.select("file_path"), "file_path", "left_semi"), F.col("code"), "text", none)
    large = shape(listing.where(F.col("n_bytes") > size_cap), none, "oversize", F.format_string("larger than %d bytes", F.lit(size_cap)))
    lost = listing.where(F.col("n_bytes") <= size_cap).join(texts.select("file_path"), "file_path", "left_anti")
    return kept.unionByName(large).unionByName(shape(lost, none, "unreadable", F.lit("listed but not readable")))


def flag_oversize(files: DataFrame, size_cap: int = DEFAULT_SIZE_CAP, text: str = "code") -> DataFrame:
    """Add ``n_bytes`` and ``within_cap``; nothing is dropped here."""
    size = F.octet_length(F.col(text))
    return files.withColumns({"n_bytes": size, "within_cap": size <= size_cap})
