"""Train/test boundaries. All need the order of dates only, so they count by date and never rank all rows in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .base import COLS, Cols, summed_before


def _boundary_index(n: Column, test_size: float) -> Column:
    """int(n * (1 - test_size)) within 0 .. n - 1."""
    return F.greatest(F.lit(0), F.least(n - 1, F.floor(n * F.lit(1 - test_size)).cast("long")))


def date_index(df: DataFrame, cols: Cols = COLS) -> DataFrame:
    """date, idx (from 0), n: the distinct dates in order."""
    return summed_before(df.select(cols.date).distinct(), F.lit(1), "idx", "n", cols.date).select(cols.date, "idx", "n")


def test_boundary(df: DataFrame, test_size: float = 1 / 3, start: str | None = None, cols: Cols = COLS) -> DataFrame:
    """One row: first_test, last_test."""
    if start is not None:
        return df.agg(F.lit(start).cast("timestamp").alias("first_test"), F.max(cols.date).alias("last_test"))
    return date_index(df, cols).agg(F.min(F.when(F.col("idx") >= _boundary_index(F.col("n"), test_size), F.col(cols.date))).alias("first_test"), F.max(cols.date).alias("last_test"))


def flag_test_set(df: DataFrame, test_size: float = 1 / 3, start: str | None = None, cols: Cols = COLS) -> DataFrame:
    """test_set = date >= boundary: an explicit start, else the distinct date at the index of the split."""
    edge = test_boundary(df, test_size, start, cols).select("first_test")  # one row
    return df.join(F.broadcast(edge), F.lit(True)).withColumn(cols.test, F.col(cols.date) >= F.col("first_test")).drop("first_test")


def flag_test_set_per_sensor(df: DataFrame, test_size: float = 1 / 3, cols: Cols = COLS) -> DataFrame:
    """The same with a boundary for each sensor."""
    of_sensor = Window.partitionBy(cols.sensor)
    dates = df.select(cols.sensor, cols.date).distinct()
    ranked = dates.select(cols.sensor, cols.date, (F.row_number().over(cols.series()) - 1).alias("_i"), F.count("*").over(of_sensor).alias("_n"))
    edges = ranked.filter(F.col("_i") >= _boundary_index(F.col("_n"), test_size)).groupBy(cols.sensor).agg(F.min(cols.date).alias("_edge"))
    return df.join(edges, cols.sensor).withColumn(cols.test, F.col(cols.date) >= F.col("_edge")).drop("_edge")


def label_splits(dated: DataFrame, val_fraction: float = 0.3, fallback: float = 0.8, cols: Cols = COLS) -> DataFrame:
    """date, idx, split for a date index with a ``test_set`` column: test from the first flagged date on, val the last part of the rest.

    Without flagged dates the last 1 - ``fallback`` of all dates are the test part.
    """
    first_test = F.coalesce(F.min(F.when(F.col(cols.test), F.col("idx"))), F.floor(F.count("*") * F.lit(fallback)).cast("long"))
    edge = dated.agg(first_test.alias("_test")).withColumn("_val", F.col("_test") - F.floor(F.col("_test") * F.lit(val_fraction)).cast("long"))  # one row
    split = F.when(F.col("idx") >= F.col("_test"), "test").when(F.col("idx") >= F.col("_val"), "val").otherwise("train")
    return dated.join(F.broadcast(edge), F.lit(True)).select(cols.date, "idx", split.alias("split"))


def target_splits(df: DataFrame, val_fraction: float = 0.3, cols: Cols = COLS) -> DataFrame:
    """Contiguous index ranges over the distinct dates: date, idx, split."""
    dates = df.groupBy(cols.date).agg(F.max(cols.test).alias(cols.test))
    return label_splits(summed_before(dates, F.lit(1), "idx", "_n", cols.date).drop("_n"), val_fraction, cols=cols)


def ratio_splits(df: DataFrame, train: float = 0.7, val: float = 0.1, cols: Cols = COLS) -> DataFrame:
    """date, idx, split by rounded shares of all distinct dates: train, then val, the rest test."""
    n_train = F.round(F.col("n") * train)
    n_test = F.round(F.col("n") * F.lit(1 - train - val))
    split = F.when(F.col("idx") < n_train, "train").when(F.col("idx") < F.col("n") - n_test, "val").otherwise("test")
    return date_index(df, cols).select(cols.date, "idx", split.alias("split"))


def global_position(df: DataFrame, cols: Cols = COLS) -> DataFrame:
    """Adds pos (from 0) in order of (date, sensor) and n: rows before the date, from counts by date, plus the rank inside the date."""
    counts = df.groupBy(cols.date).agg(F.count("*").alias("_c"))
    offsets = summed_before(counts, F.col("_c"), "_before", "n", cols.date).select(F.col(cols.date).alias("_d"), "_before", "n")
    rank = F.row_number().over(Window.partitionBy(cols.date).orderBy(cols.sensor)) - 1
    return df.join(offsets, F.col(cols.date) == F.col("_d")).withColumn("pos", (F.col("_before") + rank).cast("long")).drop("_d", "_before")


def residual_split(df: DataFrame, test_size: float = 0.33, cols: Cols = COLS) -> DataFrame:
    """is_test: the last int(n * test_size) rows in order of (date, sensor)."""
    placed = global_position(df, cols)
    return placed.withColumn("is_test", F.col("pos") >= F.col("n") - F.floor(F.col("n") * F.lit(test_size))).drop("pos", "n")


def ts_folds(df: DataFrame, k: int = 3, shuffle: bool = False, seed: int = 42, cols: Cols = COLS) -> DataFrame:
    """fold: expanding-window folds (fold i tests the i-th of k last parts of n // (k + 1) rows; 0: never tested); or hashed k-fold."""
    if shuffle:
        return df.withColumn("fold", (F.pmod(F.xxhash64(F.lit(seed), cols.sensor, cols.date), F.lit(k)) + 1).cast("int"))
    size = F.floor(F.col("n") / (k + 1))
    fold = F.greatest(F.lit(0), F.lit(k) - F.floor((F.col("n") - 1 - F.col("pos")) / size)).cast("int")
    return global_position(df, cols).withColumn("fold", fold).drop("pos", "n")


def fold_tables(folded: DataFrame, fold: int, shuffle: bool = False) -> tuple[DataFrame, DataFrame]:
    """Train and test rows of one fold."""
    train = F.col("fold") != fold if shuffle else F.col("fold") < fold
    return folded.filter(train).drop("fold"), folded.filter(F.col("fold") == fold).drop("fold")


def train_test_tables(df: DataFrame, drop: list[str], target: str = "target", cols: Cols = COLS) -> tuple[DataFrame, DataFrame]:
    """Train and test tables: features and target side by side, bookkeeping columns dropped."""
    rest = [c for c in df.columns if c not in {*drop, cols.test, target}]
    part = lambda flag: df.filter(F.col(cols.test) if flag else ~F.col(cols.test)).select(*rest, target)
    return part(False), part(True)


def split_date_gaps(a: DataFrame, b: DataFrame, cols: Cols = COLS) -> DataFrame:
    """One row: first and last dates of two sets and their differences in minutes (b - a)."""
    ends = lambda df, x: df.agg(F.min(cols.date).alias(f"min_{x}"), F.max(cols.date).alias(f"max_{x}"))
    both = ends(a, "a").join(ends(b, "b"), F.lit(True))  # one row each
    gap = lambda k: ((F.unix_seconds(F.col(f"{k}_b")) - F.unix_seconds(F.col(f"{k}_a"))) / 60).alias(f"{k}_gap")
    return both.select("*", gap("min"), gap("max"))
