"""Best-fit packing of token sequences into sequences of a fixed capacity.

How many items of each length there are is all that a packing depends on, and there are at
most ``capacity`` lengths.  So the plan is made from the counts by length, for whole
groups of equal bins at a time: items above a third of the capacity are matched in
pairs, the longest with the longest that fits; then shorter items, longest first, go to the fullest
bin that still has room.  Every item finds its place from its length and its rank
among the items of that length.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from codesieve.session import written

from .common import groups, texts
from .words import WORD_GROUP, tokenizer

PIECES = "doc_id long, piece int, start long, length long, ids binary"


def cut(df: DataFrame, path: str, capacity: int = 2048, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Token pieces of every whole text, with the end id, of at most ``capacity`` ids.

    Returns doc_id, piece (from 0), start (ids of the document before the piece), length and
    ids (little-endian unsigned 32-bit).  Only documents longer than the capacity are
    cut.  A null or empty text is one piece with the end id alone.  Rows with a null or a
    repeated doc_id are documents of their own.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, end, step = tokenizer(path), np.uint32(end_id).tobytes(), 4 * capacity
        for batch in groups(batches, chars=WORD_GROUP):
            rows = []
            for doc, ids in zip(batch.column("doc_id").to_pylist(), words.encode(batch.column("text").to_pylist())):
                ids = words.wide(ids) + end
                rows += [(doc, i // step, i // 4, len(part) // 4, part) for i in range(0, len(ids), step) for part in [ids[i:i + step]]]
            cols = list(zip(*rows))
            yield pa.record_batch([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int32()), pa.array(cols[2], pa.int64()),
                                   pa.array(cols[3], pa.int64()), pa.array(cols[4], pa.binary())], names=["doc_id", "piece", "start", "length", "ids"])

    return texts(df, id_col, text_col).mapInArrow(run, PIECES)


def plan(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int, int]]:
    """Where items go: (length, rank, n, first, per_bin, offset) says that n items of a length, from
    that rank on, go to bins from ``first`` on, per_bin in each, at that offset.

    The rows are bounded by the capacity and not by the counts: each step uses up a
    length or a group of equal bins, and splits a group at most once per length.
    """
    left = {k: n for k, n in counts.items() if n > 0}
    used = dict.fromkeys(left, 0)
    out, gaps, bins = [], [], 0  # gaps: (room, first bin, bins), sorted

    def place(length: int, n: int, first: int, per: int, offset: int) -> None:
        out.append((length, used[length], n, first, per, offset))
        used[length] += n
        left[length] -= n

    large = sorted(k for k in left if 3 * k > capacity)
    for a in reversed(large):
        while left[a]:
            at = bisect_left(large, capacity - a + 1) - 1
            while at >= 0 and (large[at] > a or left[large[at]] < 1 + (large[at] == a)):
                at -= 1
            if at < 0:
                n, room = left[a], capacity - a
                place(a, n, bins, 1, 0)
            else:
                b = large[at]
                n, room = left[a] // 2 if a == b else min(left[a], left[b]), capacity - a - b
                if a == b:
                    place(a, 2 * n, bins, 2, 0)
                else:
                    place(a, n, bins, 1, 0)
                    place(b, n, bins, 1, a)
            if room:
                insort(gaps, (room, bins, n))
            bins += n
    for k in sorted((k for k in left if 3 * k <= capacity), reverse=True):
        while n := left[k]:
            at = bisect_left(gaps, (k, -1, -1))
            if at < len(gaps):
                room, first, m = gaps.pop(at)
            else:
                room, first, m = capacity, bins, -(-n // (capacity // k))
                bins += m
            per = min(room // k, n)
            full = min(m, n // per)
            place(k, full * per, first, per, capacity - room)
            for rest in ((room - per * k, first, full), (room, first + full, m - full)):
                if rest[0] and rest[2]:
                    insort(gaps, rest)
    return out


def pack(items: DataFrame, capacity: int = 2048, length_col: str = "length", part_rows: int = 50_000) -> DataFrame:
    """``items`` with sequence_id (from 0) and offset (gapless from 0 in each sequence).

    Items whose length is null, below 1 or above the capacity get null for both.  Equal
    items are separate items.  The items' own columns stay; columns that are called
    sequence_id or offset are replaced.  An empty table gives an empty one.  A
    length that many items share is ranked in parts of about ``part_rows`` items.
    The driver gets the counts by length (at most ``capacity`` rows) and gives back the
    plan (a bounded multiple of that), which is broadcast.
    """
    names = [c for c in items.columns if c not in ("sequence_id", "offset")]
    own = [f"_c{i}" for i in range(len(names))]
    items = written(items.select(*(F.col(f"`{c}`").alias(o) for c, o in zip(names, own)),
                                 F.col(f"`{length_col}`").cast("long").alias("_length")), "packing")
    fits = F.col("_length").between(1, capacity)
    counts = {r["_length"]: r["n"] for r in items.where(fits).groupBy("_length").agg(F.count("*").alias("n")).collect()}
    parts = max(1, -(-sum(counts.values()) // part_rows))
    dealt = items.where(fits).withColumn("_part", F.pmod(F.xxhash64(*own), F.lit(parts)).cast("int"))
    before = Window.partitionBy("_length").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    base = (dealt.groupBy("_length", "_part").agg(F.count("*").alias("_n"))
            .select("_length", "_part", F.coalesce(F.sum("_n").over(before), F.lit(0).cast("long")).alias("_base")))
    ranked = dealt.withColumn("_rank", F.row_number().over(Window.partitionBy("_length", "_part").orderBy(*own)) - 1).join(base, ["_length", "_part"])
    steps = items.sparkSession.createDataFrame(plan(counts, capacity) or [(0, 0, 0, 0, 1, 0)],
                                               "_length long, _from long, _count long, _first long, _per long, _at long")
    at = F.col("_base") + F.col("_rank") - F.col("_from")
    placed = (ranked.join(F.broadcast(steps), "_length")
              .where((at >= 0) & (at < F.col("_count")))
              .select(*own, (F.col("_first") + F.floor(at / F.col("_per"))).cast("long").alias("sequence_id"),
                      (F.col("_at") + at % F.col("_per") * F.col("_length")).cast("long").alias("offset")))
    null = F.lit(None).cast("long")
    every = placed.unionByName(items.where(~F.coalesce(fits, F.lit(False))).select(*own, null.alias("sequence_id"), null.alias("offset")))
    return every.select(*(F.col(o).alias(c) for c, o in zip(names, own)), "sequence_id", "offset")
