"""Centroid search and whitening against brute force, and odd rows."""

import hashlib
import math
from decimal import Decimal

import numpy as np
import pytest

from roadspeed.llm import centroids, queries, whiten

SF = "/root/testdata/sf0.001"
SCHEMA = "vec_id long, embedding array<double>, cluster string, distance int, id int, n int, whitened int"


def vectors_of(rows):
    return [(i, v) for i, v in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]


def frame(spark, rows):
    return spark.createDataFrame([(i, v, "x", 1, 2, 3, 4) for i, v in rows], SCHEMA)


def brute_clusters(rows, k, rounds, dim, scale=256):
    """Lloyd's rounds in Python integers."""
    kept = [(i, [math.floor(scale * x) for x in v]) for i, v in vectors_of(rows) if len(v) == dim]
    key = lambda r: (1, "", r[1]) if r[0] is None else (0, hashlib.sha256(f"2:{r[0]}".encode()).hexdigest(), r[1])
    cents = [list(x) for _, x in sorted(kept, key=key)[:k]]
    best = lambda x: min((sum((a - b) ** 2 for a, b in zip(x, c, strict=True)), j) for j, c in enumerate(cents))
    for _ in range(rounds):
        at = [best(x)[1] for _, x in kept]
        for j in range(len(cents)):
            if own := [x for (_, x), a in zip(kept, at, strict=True) if a == j]:
                cents[j] = [sum(c) // len(own) for c in zip(*own, strict=True)]
    found = [(i, *best(x)) for i, x in kept]
    names = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in cents]
    return sorted((str(i), j, d, sum(y for _, y, z in found if z == j), sum(y for _, y, _ in found), names[j]) for i, d, j in found)


def clusters(df):
    return sorted((str(r.vec_id), r.cluster, r.distance, r.cluster_inertia, r.inertia, r.centroid_sha256) for r in df.collect())


def test_hadamard_keeps_distances_and_goes_from_coarse_to_fine():
    whole = centroids.hadamard(np.eye(16, dtype=np.int64)).T
    assert (whole @ whole.T == 16 * np.eye(16)).all()
    assert (np.count_nonzero(np.diff(whole, axis=1), axis=1) == range(16)).all()


@pytest.mark.parametrize("size", [1, 300, 2**40])
def test_nearest_is_exact_with_ties(size):
    rng = np.random.default_rng(size % 97)
    x, c = rng.integers(-size, size + 1, (700, 64)), rng.integers(-size, size + 1, (40, 64))
    c[9], c[30] = c[4], c[4] * 0
    x[:40], x[40:80] = c, -c
    if size > 2**20:
        x, c = x.astype(object), c.astype(object)
    d = ((x[:, None] - c[None]) ** 2).sum(axis=2)
    cluster, distance, summed = centroids.nearest(centroids.hadamard(x), centroids.hadamard(c))
    assert (cluster == d.argmin(axis=1)).all() and (distance == d.min(axis=1)).all()
    assert summed < d.size or size == 1


def test_search_drops_far_centroids_early():
    rng = np.random.default_rng(3)
    c = rng.integers(-500, 500, (40, 64))
    x = c[rng.integers(0, 40, 2000)] + rng.integers(-20, 20, (2000, 64))
    assert centroids.nearest(centroids.hadamard(x), centroids.hadamard(c))[2] < 2 * len(x)


def test_centroids_query_against_brute_force(spark):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{SF}/embeddings.parquet").limit(120).collect()]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(5)
    assert clusters(centroids.cluster(df)) == brute_clusters(rows, 40, 5, 64)
    assert queries.op11_centroids(spark, SF).count() == spark.read.parquet(f"{SF}/embeddings.parquet").count()


def test_centroids_odd_rows(spark):
    rng = np.random.default_rng(5)
    good = [(i, rng.integers(-3, 3, 4).astype(float).tolist()) for i in range(30)]
    rows = [*good, good[3], good[3], (3, [9.0, 9.0, 9.0, 9.0]), (None, [1.0, 2.0, 3.0, 4.0]), (50, [0.1, -0.1, 1e-9, -1e-9]), (51, [1e6, -1e6, 3e6, 0.0])]
    bad = [(60, None), (61, []), (62, [1.0, 2.0, 3.0]), (63, [1.0, None, 2.0, 3.0]), (64, [1.0, float("nan"), 2.0, 3.0]), (65, [1.0, float("inf"), 2.0, 3.0]), (None, None)]
    for k in (1, 7, 100):
        found = clusters(centroids.cluster(frame(spark, rows + bad), k, 3, 4))
        assert found == brute_clusters(rows, k, 3, 4)
    assert centroids.cluster(frame(spark, []), 7, 3, 4).collect() == []
    assert centroids.cluster(frame(spark, bad), 7, 3, 4).collect() == []
    wide = [(i, rng.standard_normal(5).tolist()) for i in range(40)]  # not a power of two
    assert clusters(centroids.cluster(frame(spark, wide), 6, 4, 5)) == brute_clusters(wide, 6, 4, 5)


def brute_whitening(rows, want):
    """x, n, S, exact deviations, eigenvalues and covariance by numpy's own solver."""
    x = np.array([[math.floor(1024 * c) + 100_000 for c in v] for v in rows], object)
    n, s = len(x), x.sum(axis=0)
    centred = (n * x - s).astype(float) / n
    v = centred.T @ centred / n
    values, vectors = np.linalg.eigh(v)
    return n, ((n * x - s) ** 2).sum(axis=1), values[::-1][:want], vectors[:, ::-1][:, :want], centred, np.trace(v)


def check_whitening(found, rows, want=8):
    n, deviation, values, vectors, centred, trace = brute_whitening([v for _, v in rows], want)
    by = {}
    for r in found:
        by.setdefault(r.vec_id, {})[r.component] = r
    assert len(found) == len(rows) * len(values)
    real = values > 1e-12 * max(values)
    for c in range(len(values)):
        expected = centred @ vectors[:, c] / np.sqrt(values[c]) if real[c] else None
        got = [by[i][c + 1] for i, _ in rows]
        if real[c]:
            w = np.array([r.whitened for r in got])
            assert np.allclose(w, expected, atol=1e-7) or np.allclose(w, -expected, atol=1e-7)
            assert abs((w**2).mean() - 1) < 1e-9
        else:
            assert all(r.whitened is None for r in got)
        assert all(r.explained == pytest.approx(values[c] / trace, rel=1e-9, abs=1e-15) for r in got)
        assert [int(r.deviation) for r in got] == list(deviation)
    assert {r.n for r in found} == {n} and {r.identity_error < 1e-9 for r in found} == {True}


def test_whitening_query_against_another_solver(spark):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    check_whitening(queries.op12_whiten(spark, SF).collect(), rows)


def test_whitening_odd_rows(spark):
    rng = np.random.default_rng(2)
    spread = rng.standard_normal((60, 5)) * [50, 20, 3, 0.5, 0.1] + 1000
    rows = [(i, v) for i, v in enumerate(spread.tolist())]
    bad = [(90, None), (91, []), (92, [1.0] * 4), (93, [1.0, None, 2.0, 3.0, 4.0]), (94, [1.0, float("nan"), 2.0, 3.0, 4.0]), (95, [float("-inf")] * 5), (None, None)]
    check_whitening(whiten.whiten(frame(spark, rows + bad).repartition(7)).collect(), rows)
    flat = [(i, [v[0], v[0], 7.0, v[1], v[1]]) for i, (_, v) in enumerate(rows)]  # two components and no more
    check_whitening(whiten.whiten(frame(spark, flat)).collect(), flat)
    huge = [(i, [2.0**48 * (i % 3), 2.0**47 * i]) for i in range(9)]
    found = whiten.whiten(frame(spark, huge)).collect()
    x = np.array([[1024 * int(a) + 100_000 for a in v] for _, v in huge], object)
    exact = {i: Decimal(int(d)) for i, d in enumerate(((9 * x - x.sum(axis=0)) ** 2).sum(axis=1))}
    assert all(r.deviation == exact[r.vec_id] for r in found) and max(r.identity_error for r in found) < 1e-9
    assert whiten.whiten(frame(spark, [])).collect() == [] and whiten.whiten(frame(spark, bad[:2])).collect() == []
    one = whiten.whiten(frame(spark, [(1, [1.0, 2.0]), (1, [1.0, 2.0]), (None, [1.0, 2.0])])).collect()
    assert len(one) == 6 and {(r.whitened, r.explained, r.identity_error, r.n, int(r.deviation)) for r in one} == {(None, 0.0, 0.0, 3, 0)}


@pytest.mark.parametrize("kind", ["random", "equal", "repeated", "falling", "low rank"])
def test_components_of_hard_spectra(kind):
    rng = np.random.default_rng(4)
    q = np.linalg.qr(rng.standard_normal((64, 64)))[0]
    values = {"random": rng.random(64), "equal": np.ones(64), "repeated": np.repeat([5.0, 3.0, 1.0], [4, 7, 53]), "falling": 2.0 ** -np.arange(64), "low rank": np.repeat([2.0, 1.0, 0.0], [1, 2, 61])}[kind]
    v = q * values @ q.T
    v = (v + v.T) / 2
    e, x = whiten.components(v, 8)
    assert np.allclose(e, np.sort(values)[::-1][:8], atol=1e-13)
    assert np.abs(v @ x - x * e).max() < 1e-13 and np.abs(x.T @ x - np.eye(8)).max() < 1e-13
    form = whiten.tridiagonal(v)
    assert [whiten.above(form, s) for s in (-1.0, 0.7, 6.0)] == [int((values > s).sum()) for s in (-1.0, 0.7, 6.0)]
    for low, high, n in whiten.intervals(form, 8, 4):
        assert ((values > low) & (values <= high)).sum() == n


def test_sums_are_exact_at_every_width():
    rng = np.random.default_rng(6)
    for size in (2**10, 2**29, 2**40, 2**58):
        y = rng.integers(-size, size, (50, 6))
        big = y.astype(object)
        assert (whiten.gram(y) == big.T @ big).all() and (whiten.squares(y) == (big**2).sum(axis=1)).all()
