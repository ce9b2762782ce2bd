"""Centroid clustering by a Walsh-Hadamard progressive search.

Vectors become integers. A search works on Walsh-Hadamard coefficients, which are integers too: their squared differences
add up to the squared distance times the number of coefficients, and a sum over some of them is a lower bound of it. The
coefficients are taken in order of their sign changes, coarse ones first. The centroid that is nearest after the first level
is measured in full; from then on each level drops the centroids whose sum so far is strictly above that, and the rest
is summed to the last coefficient. So the nearest centroid is exact, and ties go to the smaller number.

A round is one pass over the vectors: each task sums its vectors by cluster, Spark adds the sums of the tasks, and ``k``
rows reach the driver. Vectors are neither shuffled nor stored. A lost executor costs the tasks that it ran.

Defined cases: rows whose vector is null, has another number of entries, or holds a null or an entry that is not finite are
left out, as are other columns. An empty table gives no rows. With fewer than ``k`` vectors each one starts a centroid.
Repeated rows count as often as they occur; those with equal ids start centroids in order of their vectors, rows without an
id after all others. A centroid without vectors stays. Entries of any size are exact; a distance or a sum of
distances beyond 64 bits is an error.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .vectors import finite_vectors, floored, slices

#: Coefficients of the first level; each further level ends at twice as many.
FIRST = 4


def hadamard(x: np.ndarray) -> np.ndarray:
    """Walsh-Hadamard coefficients of each row, in order of their sign changes. Rows are as long as a power of two."""
    n, d = x.shape
    step = 1
    while step < d:
        pairs = x.reshape(n, d // (2 * step), 2, step)
        x = np.stack([pairs[:, :, 0] + pairs[:, :, 1], pairs[:, :, 0] - pairs[:, :, 1]], axis=2).reshape(n, d)
        step *= 2
    # Coefficient i multiplies entry j by the parity of their common bits.
    signs = np.array([[(i & j).bit_count() & 1 for j in range(d)] for i in range(d)])
    return x[:, np.argsort(np.abs(np.diff(signs, axis=1)).sum(axis=1), kind="stable")]


def widened(x: np.ndarray) -> np.ndarray:
    """Rows with zeros behind them, up to a power of two."""
    return np.pad(x, ((0, 0), (0, (1 << max(0, x.shape[1] - 1).bit_length()) - x.shape[1])))


def nearest(x: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Number and squared distance of the nearest centroid of each row; and how many pairs were summed to the end. Both sides are coefficients."""
    d, at = x.shape[1], min(FIRST, x.shape[1])
    total = ((x[:, None, :at] - centroids[None, :, :at]) ** 2).sum(axis=2)
    limit = ((x - centroids[total.argmin(axis=1)]) ** 2).sum(axis=1)
    row, col = np.nonzero(total <= limit[:, None])
    part = total[row, col]
    while at < d:
        to = min(2 * at, d)
        part = part + ((x[row, at:to] - centroids[col, at:to]) ** 2).sum(axis=1)
        keep = part <= limit[row]
        row, col, part, at = row[keep], col[keep], part[keep], to
    first = np.flatnonzero(np.diff(row, prepend=-1))
    best = np.minimum.reduceat(part, first)
    hit = np.flatnonzero(part == best[row])
    hit = hit[np.unique(row[hit], return_index=True)[1]]
    return col[hit], part[hit] // d, len(row)


def _safe(dim: int) -> int:
    """Largest size of entries whose sums of squared coefficients stay within 64 bits."""
    wide = 1 << max(0, dim - 1).bit_length()
    return int((2**62 // wide**2) ** 0.5) // 2


class Search:
    """Integer vectors against centroids; goes to the tasks."""

    def __init__(self, centroids: list[list[int]], scale: int, dim: int):
        self.scale, self.dim, self.safe = scale, dim, _safe(dim)
        whole = np.array(centroids, object).reshape(len(centroids), dim)
        self.small = all(abs(v) <= self.safe for c in centroids for v in c)
        self.coefficients = hadamard(widened(whole.astype(np.int64) if self.small else whole))

    def __call__(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Integer vectors, numbers of their centroids, squared distances."""
        x = floored(self.scale * vectors, self.safe if self.small else -1)
        return x, *nearest(hadamard(widened(x)), self.coefficients)[:2]


def totals(rows: DataFrame, search: Search) -> dict[int, tuple[int, int, list[int]]]:
    """Of each cluster that has any: number of vectors, sum of distances, componentwise sum. A row by cluster reaches the driver."""
    k, dim = len(search.coefficients), search.dim

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole = np.zeros((k, dim + 2), object)
        for _, vectors in slices(batches, dim):
            x, cluster, distance = search(vectors)
            order = np.argsort(cluster, kind="stable")
            starts = np.flatnonzero(np.diff(cluster[order], prepend=-1))
            both = np.concatenate([np.ones((len(x), 1), x.dtype), distance[:, None], x], axis=1)[order]
            whole[cluster[order][starts]] += np.add.reduceat(both, starts, axis=0)
        used = [c for c in range(k) if whole[c, 0]]
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), *[pa.array([int(whole[c, i]) for c in used], pa.int64()) for i in range(dim + 2)]], names)

    names = ["cluster", "n", "inertia", *[f"s{i}" for i in range(dim)]]
    parts = rows.mapInArrow(add, "cluster int, " + ", ".join(f"{n} long" for n in names[1:]))
    found = parts.groupBy("cluster").agg(*[F.sum(n).alias(n) for n in names[1:]]).collect()
    return {r[0]: (r[1], r[2], list(r[3:])) for r in found}


def start(rows: DataFrame, k: int, seed: str, scale: int) -> list[list[int]]:
    """The ``k`` vectors whose hash of seed and id is smallest."""
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")), 256)
    first = rows.orderBy(key.asc_nulls_last(), "vector").limit(k).collect()
    return [[int(v) for v in np.floor(scale * np.array(r.vector))] for r in first]


def fit(df: DataFrame, k: int = 40, rounds: int = 5, dim: int = 64, scale: int = 256, seed: str = "2", id_col: str = "vec_id", vector_col: str = "embedding") -> list[list[int]]:
    """Centroids after some rounds of assigning all vectors and moving each centroid to the floor of its vectors' mean."""
    rows = finite_vectors(df, id_col, vector_col, dim)
    centroids = start(rows, k, seed, scale)
    for _ in range(rounds if centroids else 0):
        for c, (n, _, sums) in totals(rows, Search(centroids, scale, dim)).items():
            centroids[c] = [s // n for s in sums]
    return centroids


def assign(df: DataFrame, centroids: list[list[int]], dim: int = 64, scale: int = 256, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """id, cluster, distance, cluster_inertia, inertia, centroid_sha256 of every vector that counts."""
    rows = finite_vectors(df, id_col, vector_col, dim)
    schema = T.StructType([T.StructField(id_col, rows.schema["id"].dataType), *T.StructType.fromDDL("cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string")])
    if not centroids:
        return df.sparkSession.createDataFrame([], schema)
    search = Search(centroids, scale, dim)
    inertia = {c: t[1] for c, t in totals(rows, search).items()}
    by_cluster, whole = np.array([inertia.get(c, 0) for c in range(len(centroids))], np.int64), sum(inertia.values())
    names = np.array([hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids])

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, vectors in slices(batches, dim):
            _, cluster, distance = search(vectors)
            columns = [ids, pa.array(cluster.astype(np.int32)), pa.array(distance.astype(np.int64)), pa.array(by_cluster[cluster]), pa.array(np.full(len(cluster), whole, np.int64)), pa.array(names[cluster])]
            yield pa.RecordBatch.from_arrays(columns, schema.names)

    return rows.mapInArrow(put, schema)


def cluster(df: DataFrame, k: int = 40, rounds: int = 5, dim: int = 64, scale: int = 256, seed: str = "2", id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    return assign(df, fit(df, k, rounds, dim, scale, seed, id_col, vector_col), dim, scale, id_col, vector_col)
