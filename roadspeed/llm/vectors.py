"""Vectors of a table as rows of numpy arrays: which ones count, and how they become integers."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows that are worked on at a time inside an Arrow batch.
SLICE = 4096


def all_finite(vector: Column) -> Column:
    """The vector is there, and so is each of its entries, as a finite number."""
    return F.coalesce(vector.isNotNull() & ~F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))), F.lit(False))


def finite_vectors(df: DataFrame, id_col: str, vector_col: str, dim: int | None = None) -> DataFrame:
    """Columns id and vector (doubles) of the rows whose vector is whole and finite, of ``dim`` entries if that is given."""
    rows = df.select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("vector")).filter(all_finite(F.col("vector")))
    return rows if dim is None else rows.filter(F.size("vector") == dim)


def slices(batches: Iterator[pa.RecordBatch], dim: int) -> Iterator[tuple[pa.Array, np.ndarray]]:
    """Ids and vectors (rows of a matrix) of some thousand rows at a time."""
    for batch in batches:
        for at in range(0, batch.num_rows, SLICE):
            part = batch.slice(at, SLICE)
            yield part.column(0), part.column(1).flatten().to_numpy(zero_copy_only=False).reshape(part.num_rows, dim)


def floored(values: np.ndarray, safe: int) -> np.ndarray:
    """Whole-numbered doubles as integers: 64 bits wide if none is larger than ``safe``, else without a limit."""
    values = np.floor(values)
    if not values.size or np.abs(values).max() <= safe:
        return values.astype(np.int64)
    return np.array([int(v) for v in values.ravel()], object).reshape(values.shape)
