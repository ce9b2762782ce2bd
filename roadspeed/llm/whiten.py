"""Embedding whitening by FEAST contour integration.

Entries become integers, of which Spark sums first moments, then second moments of what is left after the floor of the mean
is taken off, so that the covariance is exact before it is rounded to doubles once, whatever the partitions. Each task adds
its vectors to one matrix, in exact products: sums over tasks are dim * (dim + 1) / 2 numbers, and these reach the driver.

There the eigenvalue problem of that one matrix is solved. Inertia counts (signs of the pivots of the shifted tridiagonal
form) cut the axis into intervals that hold the largest eigenvalues. For each interval the contour integral of the resolvent,
taken by Gauss-Legendre quadrature over a half circle (complex shifted solves), filters a subspace; Rayleigh-Ritz extracts eigenpairs from
it; both are repeated until the residuals are at rounding level. If fewer pairs converge inside an interval than the inertia counts,
the subspace is doubled, so none is missed. Two more passes over the vectors measure the covariance of the whitened rows and
return them. Vectors are neither shuffled nor stored.

Defined cases: rows whose vector is null or holds a null or an entry that is not finite are left out, as are other columns.
Vectors have the length that most of them have (on a tie the larger one); those of other lengths cannot be projected and are left out. An empty table
gives no rows, as do vectors without entries. Repeated rows count as often as they occur. A component whose eigenvalue is nothing (at most
1e-12 of the largest) has a null ``whitened``, and the identity is judged over the others; where there is none, or no
spread at all, ``identity_error`` and ``explained`` are 0. Entries whose integers do not fit 64 bits are an error.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .vectors import finite_vectors, floored, slices

WIDE = pa.decimal128(38, 0)
#: Share of the largest eigenvalue up to which an eigenvalue is nothing.
NOTHING = 1e-12


def integers(vectors: np.ndarray, scale: int, shift: int) -> np.ndarray:
    x = floored(scale * vectors, 2**62)
    if x.dtype == object:
        raise OverflowError("an entry does not fit 64 bits")
    return x + shift


def wide(values: np.ndarray) -> pa.Array:
    """Integers of any size as decimals of 38 digits."""
    return pa.array(values).cast(WIDE) if values.dtype == np.int64 else pa.array([Decimal(int(v)) for v in values], WIDE)


def gram(y: np.ndarray) -> np.ndarray:
    """Exact sums of products of the columns: in doubles while no sum can pass 53 bits, in 64 bits, or without a limit."""
    most = int(np.abs(y).max(initial=0)) ** 2 * len(y)
    kind = np.float64 if most < 2**53 else np.int64 if most < 2**63 else object
    y = y.astype(kind)
    return (y.T @ y).astype(np.int64) if kind is np.float64 else y.T @ y


def squares(y: np.ndarray) -> np.ndarray:
    """Exact sum of squares of each row."""
    most = int(np.abs(y).max(initial=0))
    if most**2 * y.shape[1] < 2**63:
        return (y.astype(np.int64) ** 2).sum(axis=1)
    if y.dtype == np.int64 and most < 2**53 and y.shape[1] < 256:
        high, low = y >> 26, y & (2**26 - 1)
        return (high**2).sum(axis=1).astype(object) * 2**52 + (high * low).sum(axis=1).astype(object) * 2**27 + (low**2).sum(axis=1).astype(object)
    return (y.astype(object) ** 2).sum(axis=1)


def length(rows: DataFrame) -> int:
    """The most frequent length of the vectors, the larger one on a tie; 0 without rows."""
    sizes = rows.groupBy(F.size("vector").alias("d")).agg(F.count("*").alias("n"))
    return sizes.agg(F.max_by("d", F.struct("n", "d"))).first()[0] or 0


def first_moments(rows: DataFrame, dim: int, scale: int, shift: int) -> tuple[int, list[int]]:
    """Number of vectors and sum of each entry's integers."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums = 0, np.zeros(dim, object)
        for _, vectors in slices(batches, dim):
            x = integers(vectors, scale, shift)
            small = int(np.abs(x).max(initial=0)) * len(x) < 2**63
            n, sums = n + len(x), sums + (x if small else x.astype(object)).sum(axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(range(dim), pa.int32()), pa.array([n] * dim, pa.int64()), wide(sums)], ["i", "n", "s"])

    found = rows.mapInArrow(add, "i int, n long, s decimal(38,0)").groupBy("i").agg(F.sum("n").alias("n"), F.sum("s").cast("decimal(38,0)").alias("s")).collect()  # a row by dimension
    sums = {r.i: int(r.s) for r in found}
    return (found[0].n if found else 0), [sums.get(i, 0) for i in range(dim)]


def second_moments(rows: DataFrame, centre: np.ndarray, scale: int, shift: int) -> list[list[int]]:
    """Sums of products of the entries' integers less ``centre``."""
    dim = len(centre)
    row, col = np.triu_indices(dim)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole = np.zeros((dim, dim), object)
        for _, vectors in slices(batches, dim):
            whole += gram(integers(vectors, scale, shift) - centre)
        yield pa.RecordBatch.from_arrays([pa.array(row, pa.int32()), pa.array(col, pa.int32()), wide(whole[row, col])], ["i", "j", "s"])

    out = [[0] * dim for _ in range(dim)]
    for r in rows.mapInArrow(add, "i int, j int, s decimal(38,0)").groupBy("i", "j").agg(F.sum("s").cast("decimal(38,0)").alias("s")).collect():  # dim (dim + 1) / 2 rows
        out[r.i][r.j] = out[r.j][r.i] = int(r.s)
    return out


# Eigenpairs of one symmetric matrix
def tridiagonal(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Diagonal and the one beside it after Householder reflections, which keep the inertia."""
    a, d = v.copy(), len(v)
    for k in range(d - 2):
        x = a[k + 1 :, k].copy()
        x[0] += np.copysign(np.linalg.norm(x), x[0])
        if not (size := np.linalg.norm(x)):
            continue
        x /= size
        a[k + 1 :, k:] -= 2 * np.outer(x, x @ a[k + 1 :, k:])
        a[:, k + 1 :] -= 2 * np.outer(a[:, k + 1 :] @ x, x)
    return np.diag(a).copy(), np.diag(a, 1).copy()


def above(form: tuple[np.ndarray, np.ndarray], shift: float) -> int:
    """Number of eigenvalues above ``shift``: positive pivots of the shifted tridiagonal form."""
    diagonal, beside = form
    tiny, n, pivot, before = np.finfo(float).tiny, 0, 1.0, 0.0
    for a, b in zip(diagonal.tolist(), [*beside.tolist(), 0.0], strict=True):
        pivot = (a - shift) - before / pivot
        pivot = pivot if abs(pivot) > tiny else -tiny
        before, n = b * b, n + (pivot > 0)
    return n


def intervals(form: tuple[np.ndarray, np.ndarray], want: int, most: int) -> list[tuple[float, float, int]]:
    """(from, to, eigenvalues inside) that hold the ``want`` largest eigenvalues, each ``most`` at most where they can be told apart."""
    diagonal, beside = form
    reach = np.abs(np.append(beside, 0)) + np.abs(np.insert(beside, 0, 0))
    low, high = float((diagonal - reach).min()), float((diagonal + reach).max())
    span = max(high - low, abs(high), np.finfo(float).tiny)
    low, high = low - span / 64, high + span / 64
    a, b = low, high
    while above(form, a) != want and b - a > 1e-9 * span:
        middle = (a + b) / 2
        a, b = (middle, b) if above(form, middle) >= want else (a, middle)
    if above(form, a) != want:  # equal eigenvalues around the last one: take them all
        a = max(low, a - 1e-6 * span)
    out, todo = [], [(a, high)]
    while todo:
        x, y = todo.pop()
        n = above(form, x) - above(form, y)
        if n > most and y - x > 1e-6 * span:
            todo += [(x, (x + y) / 2), ((x + y) / 2, y)]
        elif n:
            out.append((x, y, n))
    return out


def feast(v: np.ndarray, low: float, high: float, count: int, nodes: int = 12, loops: int = 12, seed: int = 1) -> np.ndarray:
    """Orthonormal eigenvectors of the ``count`` eigenvalues between ``low`` and ``high``, as columns."""
    d, size = len(v), np.linalg.norm(v)
    points, weights = np.polynomial.legendre.leggauss(nodes)
    turn = np.exp(-0.5j * np.pi * (points - 1))
    centre, radius = (low + high) / 2, (high - low) / 2
    shifted = [(w * radius * t, (centre + radius * t) * np.eye(d) - v) for w, t in zip(weights, turn, strict=True)]
    width = min(d, count + max(4, count // 2))
    while True:
        x = np.random.default_rng(seed).standard_normal((d, width))
        for _ in range(loops):
            x = sum((factor * np.linalg.solve(matrix, x)).real for factor, matrix in shifted) / 2
            q = np.linalg.qr(x)[0]
            values, turned = np.linalg.eigh(q.T @ v @ q)
            x = q @ turned
            rest = np.linalg.norm(v @ x - x * values, axis=0)
            found = (values > low) & (values <= high) & (rest <= 4 * d * np.finfo(float).eps * size)
            if found.sum() == count:
                return x[:, found]
        if width == d:
            raise ArithmeticError(f"{found.sum()} of {count} eigenvalues between {low} and {high}")
        width = min(d, 2 * width)


def components(v: np.ndarray, want: int, most: int = 16) -> tuple[np.ndarray, np.ndarray]:
    """The largest eigenvalues, falling, and their unit eigenvectors as columns; the largest entry of each is positive."""
    want, scale = min(want, len(v)), float(np.trace(v))
    if not want or scale <= 0:
        return np.zeros(want), np.eye(len(v))[:, :want]
    v = v / scale
    pieces = [feast(v, *i) for i in intervals(tridiagonal(v), want, most)]
    q = np.linalg.qr(np.concatenate(pieces, axis=1))[0]
    values, turned = np.linalg.eigh(q.T @ v @ q)
    first = np.argsort(-values, kind="stable")[:want]
    vectors = q @ turned[:, first]
    vectors = vectors / np.linalg.norm(vectors, axis=0)
    return values[first] * scale, vectors * np.sign(vectors[np.abs(vectors).argmax(axis=0), range(want)])


class Whitening:
    """Integer moments, components and their eigenvalues; goes to the tasks."""

    def __init__(self, n: int, sums: list[int], products: list[list[int]], centre: np.ndarray, want: int, scale: int, shift: int):
        self.n, self.centre, self.scale, self.shift = n, centre, scale, shift
        #: What the floor of the mean leaves of the sums: from 0 to n.
        self.rest = [s - n * int(c) for s, c in zip(sums, centre, strict=True)]
        v = np.array([[(n * p - a * b) / (n * n) for p, b in zip(line, self.rest, strict=True)] for line, a in zip(products, self.rest, strict=True)]).reshape(len(sums), len(sums))
        self.values, self.vectors = components(v, want)
        self.real = self.values > NOTHING * self.values.max(initial=0)
        self.projection = self.vectors[:, self.real] / np.sqrt(self.values[self.real])
        total = float(np.trace(v))
        self.explained = self.values / total if total > 0 else np.zeros_like(self.values)

    def centred(self, vectors: np.ndarray) -> np.ndarray:
        return integers(vectors, self.scale, self.shift) - self.centre

    def whitened(self, y: np.ndarray) -> np.ndarray:
        return (y - np.array(self.rest) / self.n) @ self.projection

    def deviations(self, y: np.ndarray) -> np.ndarray:
        most = int(np.abs(y).max(initial=0)) * self.n + self.n
        y = y if most < 2**62 else y.astype(object)
        return squares(self.n * y - np.array(self.rest, y.dtype))


def fit(df: DataFrame, want: int = 8, scale: int = 1024, shift: int = 100_000, id_col: str = "vec_id", vector_col: str = "embedding") -> tuple[int, Whitening | None]:
    """Length of the vectors and what whitens them; none without vectors."""
    rows = finite_vectors(df, id_col, vector_col)
    if not (dim := length(rows)):
        return 0, None
    rows = rows.filter(F.size("vector") == dim)
    n, sums = first_moments(rows, dim, scale, shift)
    centre = np.array([s // n for s in sums], np.int64)
    return dim, Whitening(n, sums, second_moments(rows, centre, scale, shift), centre, want, scale, shift)


def identity_error(rows: DataFrame, dim: int, model: Whitening) -> float:
    """Largest entry of the covariance of the whitened rows, as they are returned, less the identity."""
    k = int(model.real.sum())
    if not k:
        return 0.0
    row, col = np.triu_indices(k)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole = np.zeros((k, k))
        for _, vectors in slices(batches, dim):
            w = model.whitened(model.centred(vectors))
            whole += w.T @ w
        yield pa.RecordBatch.from_arrays([pa.array(row, pa.int32()), pa.array(col, pa.int32()), pa.array(whole[row, col])], ["i", "j", "s"])

    sums = rows.mapInArrow(add, "i int, j int, s double").groupBy("i", "j").agg(F.sum("s").alias("s")).collect()
    return max(abs(r.s / model.n - (r.i == r.j)) for r in sums)


def whiten(df: DataFrame, want: int = 8, scale: int = 1024, shift: int = 100_000, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """id, component, n, deviation (a decimal of 38 digits, since it passes 64 bits at some millions of vectors), whitened, explained, identity_error: a row by vector and component."""
    dim, model = fit(df, want, scale, shift, id_col, vector_col)
    rows = finite_vectors(df, id_col, vector_col, dim)
    schema = T.StructType([T.StructField(id_col, rows.schema["id"].dataType), *T.StructType.fromDDL("component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double")])
    if model is None:
        return df.sparkSession.createDataFrame([], schema)
    error, k = identity_error(rows, dim, model), len(model.values)

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, vectors in slices(batches, dim):
            y, m = model.centred(vectors), len(vectors)
            w = np.full((m, k), np.nan)
            w[:, model.real] = model.whitened(y)
            each = pa.array(np.repeat(np.arange(m), k))
            columns = [ids.take(each), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)), pa.array(np.full(m * k, model.n)), wide(model.deviations(y)).take(each)]
            columns += [pa.array(w.ravel(), mask=np.isnan(w.ravel())), pa.array(np.tile(model.explained, m)), pa.array(np.full(m * k, error))]
            yield pa.RecordBatch.from_arrays(columns, schema.names)

    return rows.mapInArrow(project, schema)
