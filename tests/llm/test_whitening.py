"""Whitening against a direct eigendecomposition."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from codesieve.llm import whitening
from codesieve.llm.queries import QUERIES
from codesieve.llm.whitening import Spectrum, secular, whiten

SF = "/root/testdata/sf0.001"
VECTORS = "vec_id long, embedding array<float>, x int, part long, matrix string, whitened int"  # with clashing names


def table(spark, rows):
    return spark.createDataFrame([(i, v, 1, 2, "m", 3) for i, v in rows], VECTORS)


def brute(rows):
    """Integer vectors, n, sums, eigenvalues and eigenvectors (falling), trace."""
    x = [(i, [math.floor(1024 * float(np.float32(c))) + 100_000 for c in v]) for i, v in rows]
    n, sums = len(x), [sum(c) for c in zip(*(v for _, v in x))]
    y = np.array([[n * a - s for a, s in zip(v, sums)] for _, v in x], float) / n
    values, vectors = np.linalg.eigh(y.T @ y / n)
    return x, n, sums, y, values[::-1], vectors[:, ::-1]


def check(got, rows, k):
    x, n, sums, y, values, vectors = brute(rows)
    white = y @ vectors[:, :k] / np.sqrt(values[:k])
    by = {}
    for r in got:
        by.setdefault(r.component, []).append(r)
        assert r.n == n and r.identity_error < 1e-9
        assert r.explained == pytest.approx(values[r.component - 1] / values.sum(), rel=1e-9)
    assert sorted(by) == list(range(1, k + 1))
    deviation = sorted((i, sum((n * a - s) ** 2 for a, s in zip(v, sums))) for i, v in x)
    for c, found in by.items():
        assert sorted((r.vec_id, int(r.deviation)) for r in found) == deviation
        want = {i: w for (i, _), w in zip(x, white[:, c - 1])}
        sign = np.sign(sum(r.whitened * want[r.vec_id] for r in found))
        assert max(abs(sign * r.whitened - want[r.vec_id]) for r in found) < 1e-8
    return by


@pytest.mark.parametrize("dims,parts", [(12, 40), (3, 1)])
def test_against_direct_decomposition(spark, dims, parts):
    rng = np.random.default_rng(dims)
    spread = rng.choice([0.1, 1, 7], size=dims) * (1 + np.arange(dims))
    rows = [(i, [float(c) for c in rng.normal(size=dims) * spread + 5]) for i in range(400)]
    rows += [(1000 + i, rows[7][1]) for i in range(150)]  # a hot vector
    bad = [(-1, None), (-2, []), (-3, [None] + [1.0] * (dims - 1)), (-4, [math.nan] * dims), (-5, [math.inf] * dims), (-6, [1.0] * (dims + 1)), (-7, [1e30] * dims)]
    got = whiten(table(spark, rows + bad).repartition(parts)).collect()
    check(got, rows, min(8, dims))


def test_few_and_equal_vectors(spark):
    assert whiten(table(spark, [])).collect() == []
    assert whiten(table(spark, [(1, None), (2, [math.nan])])).collect() == []
    one = whiten(table(spark, [(1, [1.0, 2.0]), (None, [1.0, 2.0])])).collect()
    assert len(one) == 4 and all(r.whitened is None and r.explained == 0 and int(r.deviation) == 0 and r.identity_error == 0 for r in one)
    line = whiten(table(spark, [(i, [float(i), 2.0 * i, 0.0]) for i in range(9)])).collect()
    assert {r.component: r.whitened is None for r in line} == {1: False, 2: True, 3: True}
    assert [r.explained for r in line if r.component == 1][0] == pytest.approx(1)


def test_exact_beyond_64_bits(spark):
    rows = [(i, [float((-1) ** i * 1.5e12), float(i)]) for i in range(5000)]
    x, n, sums, *_ = brute(rows[:5000])
    got = {r.vec_id: int(r.deviation) for r in whiten(table(spark, rows)).where("component = 1").collect()}
    assert got == {i: sum((n * a - s) ** 2 for a, s in zip(v, sums)) for i, v in x}


@pytest.mark.parametrize("dims", [1, 2, 17, 64])
def test_rank_one_updates(dims):
    rng = np.random.default_rng(dims)
    rows = rng.normal(size=(120, dims)) * rng.choice([1e-6, 1, 1e4], size=dims)
    rows[40:60] = np.round(rows[40:60])
    rows[9], rows[10] = rows[8], 0
    spectrum, other = Spectrum.zero(dims), Spectrum.zero(dims)
    for i, v in enumerate(rows):
        (spectrum if i % 3 else other).add(v.copy())
    spectrum.join(other)
    want = np.linalg.eigvalsh(rows.T @ rows)
    assert np.abs(spectrum.values - want).max() <= 1e-12 * want.max()
    assert np.abs(spectrum.vectors.T @ spectrum.vectors - np.eye(dims)).max() < 1e-12
    assert np.abs((spectrum.vectors * spectrum.values) @ spectrum.vectors.T - rows.T @ rows).max() <= 1e-12 * want.max()
    again = Spectrum.unpacked(spectrum.packed(), dims)
    assert (again.values == spectrum.values).all() and (again.vectors == spectrum.vectors).all()


def test_secular_roots_interlace():
    rng = np.random.default_rng(5)
    for _ in range(200):
        d = np.cumsum(rng.choice([1e-9, 1e-3, 1, 50], size=rng.integers(1, 12)))
        z = rng.normal(size=len(d)) * rng.choice([1e-4, 1, 10])
        z[z == 0] = 1
        values, diff = secular(d, z)
        assert (values >= d).all() and (values[:-1] <= d[1:]).all() and values[-1] <= d[-1] + z @ z * (1 + 1e-12)
        assert values.sum() == pytest.approx(d.sum() + z @ z, rel=1e-12)
        assert diff.shape == (len(d), len(d))


def test_query(spark):
    got = QUERIES["op12_whitening"](spark, SF)
    assert dict(got.dtypes)["deviation"] == "bigint"
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()
            if r.embedding is not None and all(c is not None and math.isfinite(c) for c in r.embedding)]
    check(got.collect(), rows, 8)
    assert whitening.integers(spark.read.parquet(f"{SF}/embeddings.parquet")).where(F.size("x") != 64).count() == 0
