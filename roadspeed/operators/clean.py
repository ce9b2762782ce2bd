"""Cleaning of values and of ordered series."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .base import COLS, Cols


def clean_value(value: Column) -> Column:
    """Text or number to a double with two decimals: blanks stand for the decimal point; null if that is no number."""
    return F.round(F.replace(value.cast("string"), F.lit(" "), F.lit(".")).try_cast("double"), 2)


def drop_misformatted(df: DataFrame, cols: Cols = COLS) -> DataFrame:
    """Rows whose value is a number as it stands; no repair."""
    return df.withColumn(cols.value, F.col(cols.value).cast("string").try_cast("double")).filter(F.col(cols.value).isNotNull())


def align_timeframe(df: DataFrame, cols: Cols = COLS) -> DataFrame:
    """Rows between the first and last date of the sensor with the fewest rows (smallest id on a tie)."""
    spans = df.groupBy(cols.sensor).agg(F.count("*").alias("n"), F.min(cols.date).alias("lo"), F.max(cols.date).alias("hi"))
    frame = spans.agg(F.min_by(F.struct("lo", "hi"), F.struct("n", cols.sensor)).alias("_f"))  # one row
    return df.join(F.broadcast(frame), F.col(cols.date).between(F.col("_f.lo"), F.col("_f.hi"))).drop("_f")


def filter_uncommon_counts(df: DataFrame, cols: Cols = COLS) -> DataFrame:
    """Rows of the sensors with the most common number of rows (the smallest number on a tie)."""
    counts = df.groupBy(cols.sensor).agg(F.count("*").alias("_n"))
    most = counts.groupBy("_n").agg(F.count("*").alias("_c")).agg(F.max_by("_n", F.struct("_c", -F.col("_n"))).alias("_n"))
    return df.join(counts.join(F.broadcast(most), "_n", "left_semi").select(cols.sensor), cols.sensor, "left_semi")


def relative_change(cols: Cols = COLS) -> tuple[Column, Column]:
    """Relative change against the row before, gaps padded with the last value; and whether it is infinite (from zero to something)."""
    w = cols.series()
    now = F.last(cols.value, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    before = F.last(cols.value, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    return F.try_divide(now - before, before), (before == 0) & (now != 0)


def is_extreme(threshold: float, cols: Cols = COLS) -> Column:
    change, infinite = relative_change(cols)
    return F.coalesce(infinite | (F.abs(change) > threshold), F.lit(False))


def diagnose_extremes(df: DataFrame, threshold: float = 0.7, cols: Cols = COLS) -> DataFrame:
    """n_extreme, share of all rows."""
    flagged = df.withColumn("_x", is_extreme(threshold, cols))
    return flagged.agg(F.count_if("_x").alias("n_extreme"), F.avg(F.col("_x").cast("double")).alias("share"))


def interpolate_gaps(df: DataFrame, cols: Cols = COLS) -> DataFrame:
    """Fill nulls of a sensor: linear by row between neighbours, the last value behind the end, the first before the start.

    The look ahead uses a descending window: an ascending frame to the end would be quadratic.
    """
    up, down = (w.rowsBetween(Window.unboundedPreceding, 0) for w in (cols.series(), cols.latest_first()))
    known = F.when(F.col(cols.value).isNotNull(), F.struct(F.col("_row").alias("row"), F.col(cols.value).alias("v")))
    df = df.withColumn("_row", F.row_number().over(cols.series()))
    df = df.withColumn("_prev", F.last(known, ignorenulls=True).over(up)).withColumn("_next", F.last(known, ignorenulls=True).over(down))
    slope = F.try_divide(F.col("_next.v") - F.col("_prev.v"), F.col("_next.row") - F.col("_prev.row"))
    between = F.col("_prev.v") + slope * (F.col("_row") - F.col("_prev.row"))
    return df.withColumn(cols.value, F.coalesce(cols.value, between, "_prev.v", "_next.v")).drop("_row", "_prev", "_next")


def filter_extremes(df: DataFrame, threshold: float = 0.7, train_only: bool = False, cols: Cols = COLS) -> DataFrame:
    """Null every value whose relative change exceeds the threshold (all judged on the raw series), then fill the gaps.

    ``train_only``: only rows outside the test set are judged and filled, as a series of their own.
    """
    if train_only:
        train = filter_extremes(df.filter(~F.col(cols.test)), threshold, cols=cols)
        return train.unionByName(df.filter(F.col(cols.test)))
    masked = df.withColumn("_x", is_extreme(threshold, cols)).withColumn(cols.value, F.when(~F.col("_x"), F.col(cols.value))).drop("_x")
    return interpolate_gaps(masked, cols)


def smoothed(window: int = 5, median: bool = False, cols: Cols = COLS, *more: str) -> Column:
    frame = cols.trailing(window, *more)
    return F.percentile(cols.value, 0.5).over(frame) if median else F.avg(cols.value).over(frame)


def smooth_speeds(df: DataFrame, window: int = 5, median: bool = False, cols: Cols = COLS) -> DataFrame:
    """Trailing mean or median of ``window`` rows, one row at least."""
    return df.withColumn(cols.value, smoothed(window, median, cols))


def smooth_train_test_separately(df: DataFrame, window: int = 5, median: bool = False, train_only: bool = False, cols: Cols = COLS) -> DataFrame:
    """The same, begun anew at the test boundary; ``train_only`` leaves test rows as they are."""
    new = smoothed(window, median, cols, cols.test)
    return df.withColumn(cols.value, F.when(F.col(cols.test), F.col(cols.value)).otherwise(new) if train_only else new)


def elapsed_minutes(df: DataFrame, cols: Cols = COLS) -> DataFrame:
    """Minutes since the first row of the sensor."""
    first = F.min(cols.date).over(Window.partitionBy(cols.sensor))
    micros = lambda c: F.unix_micros(c.cast("timestamp"))
    return df.withColumn("elapsed_minutes", (micros(F.col(cols.date)) - micros(first)) / F.lit(60e6))


def grid_readings(df: DataFrame, step: str = "hour", full: bool = False, cols: Cols = COLS) -> DataFrame:
    """Mean value by sensor and time step; ``full`` adds the steps without readings as nulls."""
    grid = df.groupBy(cols.sensor, F.date_trunc(step, cols.date).alias(cols.date)).agg(F.avg(cols.value).alias(cols.value))
    if not full:
        return grid
    ends = grid.agg(F.min(cols.date).alias("lo"), F.max(cols.date).alias("hi"))
    steps = grid.select(cols.sensor).distinct().join(F.broadcast(ends), F.lit(True)).select(cols.sensor, F.explode(F.expr(f"sequence(lo, hi, interval 1 {step})")).alias(cols.date))
    return steps.join(grid, [cols.sensor, cols.date], "left")


def drop_columns(df: DataFrame, names: list[str]) -> DataFrame:
    """Drop those of the listed columns (weather, say) that are there."""
    return df.drop(*[c for c in names if c in df.columns])


def slice_test_raw(df: DataFrame, start: Column, cols: Cols = COLS) -> DataFrame:
    return df.filter(F.col(cols.date) >= start)


def check_monotonic(df: DataFrame, arrival: str, cols: Cols = COLS) -> DataFrame:
    """Sensors whose dates go back in order of arrival, with the number of such rows."""
    before = F.lag(cols.date).over(Window.partitionBy(cols.sensor).orderBy(arrival))
    return df.withColumn("_back", F.col(cols.date) < before).groupBy(cols.sensor).agg(F.count_if("_back").alias("n_back")).filter("n_back > 0")


def duplicate_keys(df: DataFrame, cols: Cols = COLS) -> DataFrame:
    return df.groupBy(cols.sensor, cols.date).agg(F.count("*").alias("n")).filter("n > 1")


def null_report(df: DataFrame) -> DataFrame:
    """One row: nulls of every column."""
    return df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in df.columns])


def trim_warmup(df: DataFrame, lags: int, cols: Cols = COLS) -> DataFrame:
    """Drop the first ``lags`` rows of each sensor."""
    return df.withColumn("_row", F.row_number().over(cols.series())).filter(F.col("_row") > lags).drop("_row")
