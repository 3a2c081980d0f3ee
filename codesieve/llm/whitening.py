"""Whitening of vectors by incremental eigendecomposition.

Entries become integers (``floor(1024 c) + 100000``), so sums and deviations are exact.  The spectrum of the scatter
matrix is built from rank-one updates: a task adds its centred vectors one by one to a spectrum of its own, each
by solving the secular equation of D + z z', after deflating what the update leaves as it is; the spectra of the
tasks are combined in groups of a bounded number, again by successive rank-one updates, one for each eigenpair.
The errors of so many updates add up, so the basis they end in is refined: one
distributed pass projects all vectors on it and sums their products, and the eigenvectors of that small
matrix turn the basis into the final components (Rayleigh-Ritz).

The driver and a task hold matrices of dimension x dimension and one Arrow batch, whatever the number of rows.  An update costs the
cube of the dimension: fit for vectors of some hundred entries.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codesieve.session import written

SCALE, SHIFT = 1024, 100_000
FAN_IN = 16  # matrices that one task combines
ENTRY_BELOW = float(1 << 42)  # larger entries have no exact integer; such vectors count as not finite

_EPS = np.finfo(float).eps


# ---- one rank-one update

def secular(d: np.ndarray, z: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues of diag(d) + z z' (d ascending and distinct, no z zero) and the matrix d[i] - value[k].

    Every root is sought from the pole next to it, so that its distance to both neighbours keeps its digits: the
    middle way of rational interpolation, held in a shrinking bracket, with bisection where a step leaves it.
    """
    m, z2 = len(d), z * z
    if m == 1:
        return d + z2, -z2[:, None]
    gap = np.append(np.diff(d), z2.sum())
    middle = d + gap / 2
    at_middle = 1 + (z2[:, None] / (d[:, None] - middle)).sum(0)
    origin = np.arange(m)
    right = (at_middle < 0) & (origin < m - 1)  # the root lies nearer to the pole above
    origin[right] += 1
    delta = d[:, None] - d[origin]
    low, high = np.where(right, -gap / 2, 0.0), np.where(right, 0.0, np.where(at_middle < 0, gap, gap / 2))
    low[-1], high[-1] = (gap[-1] / 2, gap[-1]) if at_middle[-1] < 0 else (0.0, gap[-1] / 2)
    tau = (low + high) / 2
    below = np.tri(m, dtype=bool).T  # poles at or under each root
    k, above = np.arange(m), np.minimum(np.arange(m) + 1, m - 1)
    for _ in range(80):
        diff = delta - tau
        w = z2[:, None] / diff
        f, size = 1 + w.sum(0), 1 + np.abs(w).sum(0)
        low, high = np.where(f < 0, tau, low), np.where(f >= 0, tau, high)
        open_ = (np.abs(f) > 8 * _EPS * size) & (high - low > 2 * _EPS * np.maximum(np.abs(low), np.abs(high)))
        if not open_.any():
            break
        w /= diff
        slope = w.sum(0)
        psi = np.where(below, w, 0.0).sum(0)
        d1, d2 = diff[k, k], diff[above, k]
        a, b, c = (d1 + d2) * f - d1 * d2 * slope, d1 * d2 * f, f - d1 * psi - d2 * (slope - psi)
        root = np.sqrt(np.maximum(a * a - 4 * b * c, 0.0))
        with np.errstate(all="ignore"):
            step = np.where(a <= 0, (a - root) / (2 * c), 2 * b / (a + root))
            step[-1] = d1[-1] + slope[-1] * d1[-1] ** 2 / (f[-1] - slope[-1] * d1[-1])
        new = tau + step
        fine = (new > low) & (new < high)
        tau = np.where(open_, np.where(fine, new, (low + high) / 2), tau)
    return d[origin] + tau, delta - tau


class Spectrum:
    """Eigenvalues (ascending) and eigenvectors (columns) of a sum of v v'."""

    def __init__(self, values: np.ndarray, vectors: np.ndarray):
        self.values, self.vectors = values, vectors

    @classmethod
    def zero(cls, dims: int) -> Spectrum:
        return cls(np.zeros(dims), np.eye(dims))

    def add(self, v: np.ndarray) -> None:
        """The spectrum of the sum with v v' added."""
        d, u = self.values, self.vectors
        z = v @ u
        norm2 = float(z @ z)
        if norm2 == 0:
            return
        least = 8 * _EPS * max(abs(d[-1]), norm2)
        moved = np.flatnonzero(np.abs(z) * np.sqrt(norm2) > least)  # the other pairs stay: deflation
        if not len(moved):
            return
        near = np.diff(d[moved]) <= least
        if near.any():  # equal values: turn their vectors so that only the last of them is moved
            kept = []
            for i, j in zip(moved, moved[1:]):
                if d[j] - d[i] <= least:
                    r = np.hypot(z[i], z[j])
                    c, s = z[j] / r, z[i] / r
                    u[:, [i, j]] = u[:, [i, j]] @ np.array([[c, s], [-s, c]])
                    z[i], z[j] = 0.0, r
                else:
                    kept.append(i)
            moved = np.array([*kept, moved[-1]])
        dk, zk = d[moved], z[moved]
        values, diff = secular(dk, zk)
        # The z whose update has exactly these values gives eigenvectors that are orthogonal to working precision.
        ratio = -diff / (dk - dk[:, None] + np.eye(len(dk)))
        q = np.copysign(np.sqrt(np.abs(ratio.prod(1))), zk)[:, None] / diff
        q /= np.sqrt((q * q).sum(0))
        u[:, moved] = u[:, moved] @ q
        d[moved] = values
        order = np.argsort(d, kind="stable")
        self.values, self.vectors = d[order], np.ascontiguousarray(u[:, order])

    def join(self, other: Spectrum) -> Spectrum:
        for value, vector in zip(other.values, other.vectors.T):
            if value > 0:
                self.add(np.sqrt(value) * vector)
        return self

    def packed(self) -> bytes:
        return np.vstack([self.values, self.vectors]).tobytes()

    @classmethod
    def unpacked(cls, raw: bytes, dims: int) -> Spectrum:
        both = np.frombuffer(raw).reshape(dims + 1, dims).copy()
        return cls(both[0], both[1:])


# ---- vectors as exact integers

def integers(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec_id, x) of the vectors that are not null and hold no null, non-finite or overly large (2^42) entry."""
    v = F.col(vector_col).cast("array<double>")
    return (df.select(F.col(id_col).cast("long").alias("vec_id"), v.alias("v"))
            .where(F.col("v").isNotNull() & (F.size("v") > 0) & ~F.exists("v", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) >= ENTRY_BELOW)))
            .select("vec_id", F.transform("v", lambda c: F.floor(c * SCALE) + SHIFT).cast("array<long>").alias("x")))


def rows_of(batch: pa.RecordBatch, dims: int) -> np.ndarray:
    return np.asarray(batch.column("x").flatten()).reshape(-1, dims)


def off_mean(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """n x - sums, exactly: as 64-bit integers where those hold it, else as Python's."""
    if x.size and max(int(np.abs(x).max()) * n, max(map(abs, sums))) >= 1 << 62:
        return x.astype(object) * n - np.array(sums, object)
    return x * np.int64(n) - np.array(sums, np.int64)


def squares(d: np.ndarray) -> list[int]:
    """Exact sums of squares of the rows."""
    if d.size and int(np.abs(d).max()) ** 2 * d.shape[1] >= 1 << 63:
        d = d.astype(object)
    return [int(s) for s in (d * d).sum(1)]


def _folded(rows: DataFrame, merge: Callable[[list[bytes]], bytes], purpose: str) -> bytes | None:
    """One matrix out of (part, matrix) rows, merged in groups of FAN_IN until one is left."""
    rows = written(rows, purpose)
    parts = (rows.agg(F.max("part")).first()[0] or 0) + 1

    def join(table: pa.Table) -> pa.Table:
        matrices = [m for _, m in sorted(zip(table["part"].to_pylist(), table["matrix"].to_pylist()))]
        return pa.table({"part": [table["part"][0].as_py() // FAN_IN], "matrix": pa.array([merge(matrices)], pa.binary())})

    while parts > 1:
        rows = written(rows.groupBy(F.floor(F.col("part") / FAN_IN)).applyInArrow(join, "part long, matrix binary"), purpose)
        parts = -(-parts // FAN_IN)
    found = rows.first()
    return bytes(found.matrix) if found else None


def _sum(matrices: list[bytes]) -> bytes:
    return np.sum([np.frombuffer(m) for m in matrices], axis=0).tobytes()


@dataclass(frozen=True)
class Whitening:
    """A fitted transformation: sums and number of the integer vectors, falling eigenvalues of their covariance, components as columns."""

    n: int
    sums: list[int]
    values: np.ndarray
    vectors: np.ndarray
    trace: float

    @property
    def dims(self) -> int:
        return len(self.sums)

    @property
    def scales(self) -> np.ndarray:
        """1 / sqrt(value); nan for components along which nothing varies."""
        seen = self.values > self.dims * _EPS * max(self.trace, 0.0)
        return np.where(seen, 1 / np.sqrt(np.where(seen, self.values, 1.0)), np.nan)


def matrix_rows(x: DataFrame, dims: int, start, add, finish) -> DataFrame:
    """(part, matrix): one matrix per task, from ``add`` over its batches of integer vectors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            if batch.num_rows:
                held = add(start() if held is None else held, rows_of(batch, dims))
        if held is not None:
            yield pa.record_batch([pa.array([TaskContext.get().partitionId()], pa.int64()), pa.array([finish(held)], pa.binary())], names=["part", "matrix"])

    return x.select("x").mapInArrow(run, "part long, matrix binary")


def totals(x: DataFrame) -> tuple[int, list[int]]:
    """Number and exact sums of the integer vectors."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                dims = len(batch.column("x")[0])
                rows = rows_of(batch, dims)
                high = rows >> 26  # two halves, so that no sum of a batch overflows
                yield pa.record_batch([pa.array(np.arange(dims), pa.int64()), pa.array([batch.num_rows] * dims, pa.int64()),
                                       pa.array(high.sum(0)), pa.array((rows - (high << 26)).sum(0))], names=["pos", "n", "high", "low"])

    whole = "decimal(38,0)"
    found = (x.select("x").mapInArrow(run, "pos long, n long, high long, low long").groupBy("pos")
             .agg(F.sum("n").alias("n"), F.sum(F.col("high").cast(whole)).alias("high"), F.sum(F.col("low").cast(whole)).alias("low"))
             .orderBy("pos").collect())
    return (found[0].n, [(int(r.high) << 26) + int(r.low) for r in found]) if found else (0, [])


def of_one_length(x: DataFrame) -> DataFrame:
    """The vectors of the most common number of dimensions (the larger one of equals)."""
    most = x.groupBy(F.size("x").alias("dims")).count().orderBy(F.desc("count"), F.desc("dims")).first()
    return x.where(F.size("x") == (most.dims if most else 0))


def fit(x: DataFrame) -> Whitening | None:
    """The whitening of all ``x`` (see :func:`integers`, :func:`of_one_length`); None if there are none."""
    n, sums = totals(x)
    if not n:
        return None
    dims = len(sums)

    def centred(rows):
        return off_mean(rows, n, sums).astype(float) / n

    def update(spectrum, rows):
        for v in centred(rows):
            spectrum.add(v)
        return spectrum

    def combine(matrices):
        first, *others = (Spectrum.unpacked(m, dims) for m in matrices)
        for other in others:
            first.join(other)
        return first.packed()

    spectra = matrix_rows(x, dims, lambda: Spectrum.zero(dims), update, Spectrum.packed)
    basis = np.linalg.qr(Spectrum.unpacked(_folded(spectra, combine, "spectra"), dims).vectors[:, ::-1])[0]

    def product(held, rows):
        y = centred(rows) @ basis
        return held + y.T @ y

    products = matrix_rows(x, dims, lambda: np.zeros((dims, dims)), product, np.ndarray.tobytes)
    ritz = np.frombuffer(_folded(products, _sum, "products")).reshape(dims, dims) / n
    values, turn = np.linalg.eigh((ritz + ritz.T) / 2)
    vectors = basis @ turn[:, ::-1]
    vectors *= np.where(vectors[np.abs(vectors).argmax(0), np.arange(dims)] < 0, -1.0, 1.0)
    return Whitening(n, sums, np.maximum(values[::-1], 0.0), vectors, float(np.trace(ritz)))


def transform(x: DataFrame, model: Whitening, components: int) -> DataFrame:
    """(vec_id, deviation, whitened) of each row: ``deviation`` the exact sum of squares of n x - sums (null beyond 38
    digits), ``whitened`` an array with one entry per component, null where the component has no variance."""
    scaled = model.vectors[:, :components] * model.scales[:components]
    n, sums, dims = model.n, model.sums, model.dims

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from decimal import Decimal

        for batch in batches:
            if not batch.num_rows:
                continue
            d = off_mean(rows_of(batch, dims), n, sums)
            y = (d.astype(float) / n) @ scaled
            flat = pa.array(y.ravel(), mask=np.isnan(y.ravel()))
            deviation = [Decimal(s) if s < 10 ** 38 else None for s in squares(d)]
            yield pa.record_batch([batch.column("vec_id"), pa.array(deviation, pa.decimal128(38, 0)),
                                   pa.ListArray.from_arrays(pa.array(np.arange(len(d) + 1) * y.shape[1], pa.int32()), flat)],
                                  names=["vec_id", "deviation", "whitened"])

    return x.select("vec_id", "x").mapInArrow(run, "vec_id long, deviation decimal(38,0), whitened array<double>")


def identity_error(x: DataFrame, model: Whitening, components: int) -> float:
    """Largest absolute entry of the covariance of the whitened rows minus the identity, over components with variance."""
    scales = model.scales[:components]
    scaled = (model.vectors[:, :components] * scales)[:, ~np.isnan(scales)]
    n, sums, k = model.n, model.sums, scaled.shape[1]
    if not k:
        return 0.0

    def product(held, rows):
        y = np.column_stack([(off_mean(rows, n, sums).astype(float) / n) @ scaled, np.ones(len(rows))])
        return held + y.T @ y

    sums_of = np.frombuffer(_folded(matrix_rows(x, model.dims, lambda: np.zeros((k + 1, k + 1)), product, np.ndarray.tobytes), _sum, "identity")).reshape(k + 1, k + 1) / n
    return float(np.abs(sums_of[:k, :k] - np.outer(sums_of[:k, k], sums_of[:k, k]) - np.eye(k)).max())


OUT = "vec_id long, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double"


def whiten(df: DataFrame, components: int = 8, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """A row per vector and component, numbered from 1 by falling variance.

    Vectors that are null, empty, hold null, non-finite or overly large entries, or have another length than most, are
    left out.  Rows without an id and repeated rows count like any other.  ``explained`` is the component's share of the variance.  Components
    along which nothing varies have null whitened values and explain 0; of n vectors fewer than n components vary.
    Fewer dimensions than ``components`` give as many components.  Other columns stay behind, whatever their names.
    """
    x = of_one_length(integers(df, id_col, vector_col))
    model = fit(x)
    if model is None:
        return df.sparkSession.createDataFrame([], OUT)
    k = min(components, model.dims)
    share = [float(v / model.trace) if np.isfinite(s) else 0.0 for v, s in zip(model.values[:k], model.scales)]
    error = identity_error(x, model, k)
    return (transform(x, model, k).select("vec_id", "deviation", F.posexplode("whitened").alias("pos", "whitened"))
            .select("vec_id", (F.col("pos") + 1).alias("component"), F.lit(model.n).cast("long").alias("n"), "deviation", "whitened",
                    F.get(F.array(*map(F.lit, share)), F.col("pos")).alias("explained"), F.lit(error).alias("identity_error")))
