"""Near-duplicate embeddings by an epsilon grid order join.

Unit vectors are turned so that their leading axes are the principal ones, put into cells as wide as the largest
distance of a link, and sorted by their cells, one axis after the other.  The sequence is cut into intervals, and intervals of
intervals; pairs of intervals are joined from the whole sequence down, and a pair whose boxes are provably further apart than a link goes
no further.  What is left are pairs of blocks, compared exactly.  Few pairs get their blocks by a shuffle; if many are left, tasks
read the written blocks again instead, so that disk does not grow with the pairs.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codesieve.session import written

from .common import components, forest, id_bounds

FANOUT = 8  # intervals in an interval of the next level
SHORT = 24  # leading axes on which vectors are compared first
BLOCK_BYTES = 4_000_000  # vectors of a block, if a block of the least rows takes less
PART_BYTES, MOST_TASKS = 64_000_000, 32  # vectors that a task writes, unless there are fewer tasks than this
BLOCKS = "block long, part int, ids binary, copies binary, vectors binary, low array<double>, high array<double>"


def usable(vector: Column) -> Column:
    """Whether a vector has a direction: not null, without null or non-finite components, not zero."""
    finite = F.forall(vector, lambda x: F.coalesce((x == x) & (F.abs(x.cast("double")) < math.inf), F.lit(False)))
    return F.coalesce(finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def basis(sample: np.ndarray, axes: int) -> np.ndarray:
    """The leading principal axes of unit vectors, as columns.  A bad choice costs pruning, never a link."""
    if len(sample) < 2:
        return np.eye(sample.shape[1])[:, :axes]
    _, turned = np.linalg.eigh(np.cov(sample.T).reshape(sample.shape[1], -1))
    return turned[:, ::-1][:, :axes]


def matrix(column: pa.Array, width: int, kind: type = np.float64) -> np.ndarray:
    """A column of lists as the rows of a matrix; shorter ones are padded with zeros."""
    out = np.zeros((len(column), width), kind)
    out[np.arange(width) < np.asarray(pc.list_value_length(column))[:, None]] = np.asarray(column.flatten())
    return out


def units(raw: np.ndarray) -> np.ndarray:
    """Unit vectors in double precision.  Scaled first, so that squares stay finite."""
    out = raw / np.abs(raw).max(axis=1, keepdims=True).astype(float)
    return out / np.sqrt((out * out).sum(axis=1, keepdims=True))


def _hashes(vector: Column) -> dict[str, Column]:
    """Two hashes by which equal vectors are told."""
    return {"h1": F.xxhash64(vector), "h2": F.xxhash64(F.lit(1), vector)}


def _kind(rows: DataFrame) -> type:
    """Floats are kept as they are and made unit vectors where they are used; doubles would take twice the disk."""
    return np.float32 if rows.schema["vector"].dataType.elementType.typeName() == "float" else np.float64


def _blocks(rows: DataFrame, width: int, axes: np.ndarray, distance: float, block_rows: int, tasks: int | None = None) -> DataFrame:
    """The sequence in blocks of at most ``block_rows`` vectors: packed ids, copies and vectors (as given), and their box on the leading axes.

    ``rows`` are (rep, copies, vector); rows of equal vectors become one, with the least rep.  Vectors are shuffled once and written
    once.  ``tasks`` is the number of tasks that write them.
    """
    bits = max(1, math.ceil(math.log2(2 * math.ceil(1 / distance) + 2)))
    used, shift, kind = min(axes.shape[1], 48 // bits), math.ceil(1 / distance) + 1, _kind(rows)
    rows = rows.select("rep", "copies", *(h.alias(name) for name, h in _hashes(F.col("vector")).items()),
                       F.col("vector").cast("array<float>" if kind is np.float32 else "array<double>").alias("vector"))

    def place(batch: pa.RecordBatch, raw: np.ndarray) -> np.ndarray:
        cells = np.clip(np.floor(units(raw) @ axes[:, :used] / distance).astype(np.int64) + shift, 0, (1 << bits) - 1)
        key = np.zeros(len(raw), np.int64)
        for i in range(used):
            key = key << bits | cells[:, i]
        # equal cells are told apart by a few bits of the hash, so that a crowded cell can be cut
        return key << 4 | np.asarray(batch.column("h1")) & 15

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield pa.record_batch([pa.array(place(batch, matrix(batch.column("vector"), width, kind)))], names=["key"])

    bounds = np.array(id_bounds(written(rows.mapInArrow(keys, "key long"), "vectors-keys"), "key", block_rows)[1:], np.int64)

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            # equal vectors of a batch go on as one, so that very common ones are not sent by the row
            hashes, reps, copies = (np.stack([np.asarray(batch.column(c)) for c in ("h1", "h2")]), *(np.asarray(batch.column(c)) for c in ("rep", "copies")))
            _, at, same = np.unique(hashes, axis=1, return_index=True, return_inverse=True)
            least, total = np.full(len(at), np.iinfo(np.int64).max), np.zeros(len(at), np.int64)
            np.minimum.at(least, same.ravel(), reps)
            np.add.at(total, same.ravel(), copies)
            batch = batch.take(pa.array(at))
            raw = matrix(batch.column("vector"), width, kind)
            key = place(batch, raw)
            yield pa.record_batch([pa.array(np.searchsorted(bounds, key, side="right").astype(np.int64)), pa.array(key), batch.column("h1"), batch.column("h2"),
                                   pa.array(least), pa.array(total), pa.array([v.tobytes() for v in raw], pa.binary())], names=["block", "key", "h1", "h2", "rep", "copies", "raw"])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, block, part, last = [], None, 0, None

        def close():
            ids, copies, vectors = zip(*held)
            on = units(np.frombuffer(b"".join(vectors), kind).reshape(len(held), width)) @ axes
            return pa.record_batch([pa.array([block], pa.int64()), pa.array([part], pa.int32()), pa.array([np.array(ids, np.int64).tobytes()], pa.binary()),
                                    pa.array([np.array(copies, np.int64).tobytes()], pa.binary()), pa.array([b"".join(vectors)], pa.binary()),
                                    pa.array([on.min(axis=0).tolist()], pa.list_(pa.float64())), pa.array([on.max(axis=0).tolist()], pa.list_(pa.float64()))],
                                   names=["block", "part", "ids", "copies", "vectors", "low", "high"])

        for batch in batches:
            for b, h1, h2, *row in zip(*(batch.column(c).to_pylist() for c in ("block", "h1", "h2", "rep", "copies", "raw"))):
                if last == (b, h1, h2):
                    held[-1][:2] = min(held[-1][0], row[0]), held[-1][1] + row[1]
                    continue
                if held and (b != block or len(held) == block_rows):
                    yield close()
                    held, part = [], part + 1 if b == block else 0
                block, last = b, (b, h1, h2)
                held.append(row)
        if held:
            yield close()

    numbered = rows.mapInArrow(number, "block long, key long, h1 long, h2 long, rep long, copies long, raw binary")
    dealt = numbered.repartition(tasks, "block") if tasks else numbered.repartition("block")
    return written(dealt.sortWithinPartitions("block", "key", "h1", "h2").mapInArrow(cut, BLOCKS), "vectors-blocks")


def _near(distance: float) -> Column:
    """Whether two boxes (low, high) and (low2, high2) may hold vectors within a distance; with some room for rounding."""
    gaps = F.zip_with(F.arrays_zip("low", "high"), F.arrays_zip("low2", "high2"),
                      lambda x, y: F.greatest(F.lit(0.0), x["low"] - y["high2"], y["low2"] - x["high"]))
    return F.aggregate(gaps, F.lit(0.0), lambda acc, g: acc + g * g) <= (distance * (1 + 1e-9)) ** 2 + 1e-12


def _box(column: str, axes: int, how) -> Column:
    return F.array(*(how(F.get(column, F.lit(i))) for i in range(axes)))


def block_pairs(blocks: DataFrame, axes: int, distance: float, top: int) -> DataFrame:
    """Pairs of blocks (block, part, block2, part2), each once, that may hold a link, from the whole sequence down.

    Each step joins the surviving pairs of intervals with the intervals in them, by the number of the interval: at most
    FANOUT times FANOUT rows for a pair.  ``top`` is the largest block number.
    """
    leaves = blocks.select(F.col("block").alias("up"), F.struct("block", "part").alias("node"), "low", "high")
    levels, size = [leaves], 1
    while top // size > 0 or size == 1:
        below = blocks.groupBy(F.floor(F.col("block") / size).alias("n")).agg(_box("low", axes, F.min).alias("low"), _box("high", axes, F.max).alias("high"))
        size *= FANOUT
        levels.append(below.select(F.floor(F.col("n") / FANOUT).alias("up"), F.struct("n").alias("node"), "low", "high"))
    pairs = blocks.sparkSession.createDataFrame([(0, 0)], "up long, up2 long")
    for level in reversed(levels):
        other = level.select(F.col("up").alias("up2"), F.col("node").alias("node2"), F.col("low").alias("low2"), F.col("high").alias("high2"))
        pairs = pairs.join(level, "up").join(other, "up2").where("node <= node2").where(_near(distance)).select("node", "node2")
        if level is not leaves:
            pairs = pairs.select(F.col("node.n").alias("up"), F.col("node2.n").alias("up2"))
    return pairs.select("node.block", "node.part", F.col("node2.block").alias("block2"), F.col("node2.part").alias("part2"))


class Tile(NamedTuple):
    """The vectors of a block as they are compared: in double precision, and in single precision on the leading axes with the length of the rest."""

    ids: np.ndarray
    copies: np.ndarray
    unit: np.ndarray
    short: np.ndarray
    low: np.ndarray  # boxes of every ``rows`` vectors
    high: np.ndarray


def _tile(ids: bytes, copies: bytes, vectors: bytes, kind: type, turned: np.ndarray, axes: int, rows: int) -> Tile:
    unit = units(np.frombuffer(vectors, kind).reshape(-1, len(turned)))
    on = unit @ turned
    rest = np.sqrt(np.maximum(0, 1 - (on * on).sum(axis=1)))
    starts = np.arange(0, len(unit), rows)
    return Tile(np.frombuffer(ids, np.int64), np.frombuffer(copies, np.int64), unit, np.column_stack((on, rest)).astype(np.float32),
                np.minimum.reduceat(on[:, :axes], starts), np.maximum.reduceat(on[:, :axes], starts))


def linked(one: Tile, two: Tile, same: bool, least: float, distance: float, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """The pairs (a, b) of vectors with a cosine of at least ``least``, a < b within a tile.

    The product on the leading axes plus that of the lengths of the rests is never less than the cosine, but for rounding;
    pairs that it lets through are compared in double precision.
    """
    gaps = np.maximum(0, np.maximum(one.low[:, None] - two.high, two.low - one.high[:, None]))
    found = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
    for i, j in zip(*np.nonzero((gaps * gaps).sum(axis=2) <= (distance * (1 + 1e-9)) ** 2 + 1e-12)):
        if same and j < i:
            continue
        s, t = slice(i * rows, (i + 1) * rows), slice(j * rows, (j + 1) * rows)
        product = one.short[s] @ two.short[t].T
        a, b = np.divmod(np.flatnonzero(product >= least - 1e-5), product.shape[1])
        if same and i == j:
            a, b = a[a < b], b[a < b]
        if not len(a):
            continue
        u, v = one.unit[s], two.unit[t]
        cosine = (u @ v.T)[a, b] if 16 * len(a) > product.size else np.einsum("ij,ij->i", u[a], v[b])
        found.append((a[cosine >= least] + i * rows, b[cosine >= least] + j * rows))
    a, b = zip(*found)
    return np.concatenate(a), np.concatenate(b)


def _links(one: Tile, two: Tile, same: bool, least: float, distance: float, rows: int) -> pa.Table:
    a, b = linked(one, two, same, least, distance, rows)
    ids = one.ids if same else np.concatenate((one.ids, two.ids))
    at = 0 if same else len(one.ids)
    links = np.bincount(a, two.copies[b], len(ids)) + np.bincount(b + at, one.copies[a], len(ids))
    some = np.flatnonzero(links)
    some = some[np.argsort(ids[some], kind="stable")]  # so that the least node is the least id
    place = np.zeros(len(ids), np.int64)
    place[some] = np.arange(len(some))
    root = ids[some][forest(place[a], place[b + at], len(some))]
    return pa.table({"id": pa.array(ids[some]), "links": pa.array(links[some].astype(np.int64)), "root": pa.array(root)})


def compare(blocks: DataFrame, pairs: DataFrame, least: float, distance: float, turned: np.ndarray, axes: int, rows: int, kind: type,
            most_copies: float) -> DataFrame:
    """(id, links, root) from exact comparisons: the number of vectors that a representative links with in one pair of blocks, and the
    least representative that it reaches there.  A task holds one pair of blocks at a time.

    If the pairs take at most ``most_copies`` copies of the blocks, these are sent to their pairs.  Else pairs are too many
    to be sent: tasks read the written blocks again, each the pairs between two of their parts, and nothing is shuffled.
    """
    names, schema, parts = ["block", "part", "block2", "part2"], "id long, links long, root long", ["ids", "copies", "vectors"]

    def tile(values: Iterable[bytes]) -> Tile:
        return _tile(*values, kind, turned, axes, rows)

    if pairs.where("block != block2 or part != part2").count() * 2 > most_copies * blocks.count():
        def run_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            last = None, None  # all pairs of a block come in a row
            for batch in batches:
                for i in range(batch.num_rows):
                    block, part, block2, part2, *packed = (batch.column(c)[i].as_py() for c in (*names, *parts, *(f"{c}2" for c in parts)))
                    if last[0] != (block, part):
                        last = (block, part), tile(packed[:3])
                    same = (block, part) == (block2, part2)
                    yield from _links(last[1], last[1] if same else tile(packed[3:]), same, least, distance, rows).to_batches()

        other = blocks.select(*(F.col(c).alias(f"{c}2") for c in blocks.columns))
        ordered = (F.col("block") < F.col("block2")) | (F.col("block") == F.col("block2")) & (F.col("part") <= F.col("part2"))
        both = blocks.join(other, ordered & _near(distance))
        return both.select(*names, *parts, *(f"{c}2" for c in parts)).mapInArrow(run_pairs, schema)

    def run(table: pa.Table) -> pa.Table:
        tiles = [tile(table.column(c)[i].as_py() for c in parts) for i in np.argsort(np.asarray(table.column("side")))]
        return _links(tiles[0], tiles[-1], len(tiles) == 1, least, distance, rows)

    first = pairs.select(*names, F.lit(0).alias("side"), F.col("block").alias("b"), F.col("part").alias("p"))
    second = pairs.where("block != block2 or part != part2").select(*names, F.lit(1).alias("side"), F.col("block2").alias("b"), F.col("part2").alias("p"))
    sides = first.unionByName(second).join(blocks.select(F.col("block").alias("b"), F.col("part").alias("p"), *parts), ["b", "p"])
    return sides.select(*names, "side", *parts).groupBy(*names).applyInArrow(run, schema)


def block_size(n: int, row_bytes: int, block_rows: int) -> int:
    """Rows of a block: multiples of ``block_rows`` that leave some 32 blocks and 4 MB."""
    return block_rows * max(1, min(n // (32 * block_rows), BLOCK_BYTES // (row_bytes * block_rows)))


def near_vectors(df: DataFrame, least: float = 0.95, axes: int = 8, block_rows: int = 1024, sample_rows: int = 4096,
                 id_col: str = "vec_id", vector_col: str = "embedding", most_copies: float = 2) -> DataFrame:
    """vec_id, n_links, component_id, kept of every vector, linking pairs with a cosine of at least ``least`` in double precision.

    n_links is the number of other vectors linked directly, component_id the least vec_id reached over links, kept whether it
    is the vector's own.  Vectors that are null, zero or hold null or non-finite components link with nothing; shorter
    vectors count as padded with zeros.  Equal vectors stand for each other and are compared once; no pair is ever a row.
    A null vec_id has no links, a null component and is not kept; rows that share a vec_id are vectors of their own with one
    component.  The axes are fitted on at most ``sample_rows`` vectors, which affects only how much is pruned.
    Shuffles and tables take a few times the input whatever is pruned: blocks are sent to their pairs only if that takes at most ``most_copies`` copies of them.
    """
    data = df.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).alias("vector"))
    good = F.col("vec_id").isNotNull() & usable(F.col("vector"))
    keyed = data.withColumns({name: F.when(good, h) for name, h in _hashes(F.col("vector")).items()})
    # Vectors stay out of this table and its shuffle: their blocks find equal ones by themselves.
    reps = written(keyed.where("h1 is not null").groupBy("h1", "h2").agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies")), "vectors-reps")
    rows = data.where(good).select(F.col("vec_id").alias("rep"), F.lit(1).cast("long").alias("copies"), "vector")
    n, width = reps.count(), rows.agg(F.max(F.size("vector"))).first()[0]
    keys = keyed.select("vec_id", "h1", "h2")
    if width is None:
        zero = F.lit(0).cast("long")
        return keys.select("vec_id", zero.alias("n_links"), F.col("vec_id").alias("component_id"), F.col("vec_id").isNotNull().alias("kept"))
    sample = rows.orderBy(F.xxhash64("rep")).limit(sample_rows).select(F.col("vector").cast("array<double>").alias("vector")).collect()
    # A prefix of the axes for boxes, more of them to tell vectors apart.
    turned = basis(units(matrix(pa.array([r["vector"] for r in sample], pa.list_(pa.float64())), width)), min(max(axes, SHORT), width))
    axes, kind = min(axes, width), _kind(rows)
    distance = math.sqrt(max(1e-12, 2 - 2 * least))
    size = block_size(n, width * np.dtype(kind).itemsize, block_rows)
    tasks = max(1, min(-(-n // size), max(MOST_TASKS, n * width * np.dtype(kind).itemsize // PART_BYTES)))
    blocks = _blocks(rows, width, turned[:, :axes], distance, size, tasks)
    top = blocks.agg(F.max("block")).first()[0]
    pairs = written(block_pairs(blocks, axes, distance, top), "vectors-pairs")
    found = written(compare(blocks, pairs, least, distance, turned, axes, block_rows, kind, most_copies), "vectors-links")
    comp = components(found.where("id != root").select(F.col("id").alias("a"), F.col("root").alias("b")), "vectors-components")
    links = found.groupBy("id").agg(F.sum("links").alias("links"))
    classes = (reps.select("h1", "h2", F.col("rep").alias("id"), "copies").join(links, "id", "left").join(comp, "id", "left")
               .select("h1", "h2", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("component", "id").alias("component_id")))
    return keys.join(classes, ["h1", "h2"], "left").select(
        "vec_id", F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id")) \
        .withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
