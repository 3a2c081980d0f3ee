"""Helpers shared by the operators of this package."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from codesieve.session import written

# Texts go through Python in groups of at most this many characters (or one text).
GROUP_CHARS = 300_000


def table(spark, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text) of a table, null texts as empty ones; other columns, whatever their names, stay behind."""
    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))


def groups(batches: Iterator[pa.RecordBatch], text: str = "text", chars: int = GROUP_CHARS) -> Iterator[pa.RecordBatch]:
    """Slices of Arrow batches whose texts together stay small; a single long text is a slice by itself."""
    for batch in batches:
        sizes = np.asarray(pc.binary_length(batch.column(text)).fill_null(0))
        start = total = 0
        for i, size in enumerate(sizes):
            if i > start and total + size > chars:
                yield batch.slice(start, i - start)
                start, total = i, 0
            total += int(size)
        if batch.num_rows > start:
            yield batch.slice(start)


def id_bounds(df: DataFrame, id_col: str, rows: int, most: int = 20_000) -> list[int]:
    """First ids of contiguous id ranges of about ``rows`` rows each, the smallest id first.

    Every bound is an id that occurs, whatever its size: quantiles only say where to cut, and the bound is the
    least id of a cut.  ``most`` bounds the list that the driver and the tasks hold; beyond it ranges get longer, and no row is left out.
    """
    ids = df.select(F.col(id_col).cast("long").alias("id")).where("id is not null")
    n = ids.count()
    if not n:
        return []
    parts = max(1, min(most, -(-n // rows)))
    cuts = np.unique(ids.stat.approxQuantile("id", [i / parts for i in range(1, parts)], 1 / (8 * parts))) if parts > 1 else np.zeros(0)

    def least(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                values = np.sort(np.asarray(batch.column("id")))
                part = np.searchsorted(cuts, values.astype(float), side="right")  # rounding to doubles keeps the order
                first = np.flatnonzero(np.diff(part, prepend=-1))
                yield pa.record_batch([pa.array(part[first].astype(np.int64)), pa.array(values[first])], names=["part", "id"])

    return sorted(r.id for r in ids.mapInArrow(least, "part long, id long").groupBy("part").agg(F.min("id").alias("id")).collect())


def forest(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """The least node reached by links (a, b) among n nodes, for each node."""
    root = np.arange(n)
    while True:
        new = root.copy()
        np.minimum.at(new, a, root[b])
        np.minimum.at(new, b, root[a])
        new = new[new]
        if (new == root).all():
            return root
        root = new


def components(links: DataFrame, purpose: str = "components") -> DataFrame:
    """Connected components of ``links`` (a, b): rows (id, component), the component's
    least id, for every id that has a link.

    Large-star and small-star steps as joins and sums by key, so a hub with many
    links is never gathered in one place (its join partition can be split).  Each
    round is written to the shared folder; rounds grow with the logarithm of the
    largest component.  Null ids are left out.
    """
    edges = written(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
                    .where("a is not null and b is not null and a != b").distinct(), purpose)
    state = None
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        large = written(large, purpose)
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = (large.join(least, "a").where("b != m").select(F.col("b").alias("a"), F.col("m").alias("b"))
                 .unionByName(least.select("a", F.col("m").alias("b"))).distinct())
        edges = written(small, purpose)
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == state:
            break
        state = now
    found = edges.groupBy("a").agg(F.min("b").alias("component")).withColumnRenamed("a", "id")
    return found.unionByName(found.select(F.col("component").alias("id"), "component").distinct())


def starts(counts: DataFrame, by: list[str], n: str) -> DataFrame:
    """``counts`` with ``start``, the sum of ``n`` over all earlier rows in the order of ``by``.

    Two levels: within the first key, and over its totals, so that no task gets more
    rows than one first key has, or there are first keys.
    """
    inner = Window.partitionBy(by[0]).orderBy(*by[1:]).rowsBetween(Window.unboundedPreceding, -1)
    outer = Window.orderBy(by[0]).rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0).cast("long")
    totals = counts.groupBy(by[0]).agg(F.sum(n).alias("_n")).select(by[0], F.coalesce(F.sum("_n").over(outer), zero).alias("_base"))
    return (counts.withColumn("_inner", F.coalesce(F.sum(n).over(inner), zero)).join(totals, by[0])
            .withColumn("start", F.col("_inner") + F.col("_base")).drop("_inner", "_base"))
