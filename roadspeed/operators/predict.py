"""Prediction frames, corrections, reshaping, sequence windows and error metrics."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.kernels import ewma, kalman
from ..functions.quantiles import exact_quantiles
from .base import COLS, Cols, minutes
from .clean import duplicate_keys

#: Not read any more: windows are frames, which make one row at a time. The name stays for those who set it.
PIECE_ROWS = 1024


# Frames
def prediction_frame(df: DataFrame, delta: str, horizon_min: int, cols: Cols = COLS) -> DataFrame:
    """input_time, sensor, prediction_time, y_pred_delta, y_pred_total."""
    d = F.col(cols.date)
    return df.select(d.alias("input_time"), cols.sensor, (d + minutes(horizon_min)).alias("prediction_time"), F.col(delta).alias("y_pred_delta"), (F.col(delta) + F.col(cols.value)).alias("y_pred_total"))


def infer_horizon(df: DataFrame, cols: Cols = COLS) -> DataFrame:
    """One row: the median of prediction_time - date in whole minutes."""
    gap = (F.unix_seconds("prediction_time") - F.unix_seconds(cols.date)) / 60
    return exact_quantiles(df, gap, {"m": 0.5}).select(F.round("m", 0).cast("int").alias("horizon_min"))


def reconstruct_target(df: DataFrame, prediction: str, base: str, mean: float = 0.0, std: float = 1.0) -> DataFrame:
    """y_total: the prediction, scaled back, plus its base (the value or an external prediction)."""
    return df.withColumn("y_total", F.col(prediction) * F.lit(std) + F.lit(mean) + F.col(base))


def residual_table(df: DataFrame, truth: str = "y", prediction: str = "y_pred", cols: Cols = COLS) -> DataFrame:
    """residual_target, and the model's prediction and delta as features."""
    return df.withColumns({"residual_target": F.col(truth) - F.col(prediction), "model_pred": F.col(prediction), "model_delta": F.col(prediction) - F.col(cols.value)})


def residual_correction(df: DataFrame, residual: str, threshold: float | None = None, prediction: str = "y_pred") -> DataFrame:
    """y_corr: the prediction plus the predicted residual, always or where it exceeds the threshold."""
    p, r = F.col(prediction), F.col(residual)
    return df.withColumn("y_corr", p + r if threshold is None else F.when(F.abs(r) > threshold, p + r).otherwise(p))


# Corrections, each rounded half-even to two decimals
def correct_naive(df: DataFrame, threshold: float = 0.5, prediction: str = "y_pred", cols: Cols = COLS) -> DataFrame:
    """The current value in place of a prediction that differs from it by more than a share."""
    p, v = F.col(prediction), F.col(cols.value)
    return df.withColumn(prediction, F.bround(F.when(F.abs(F.try_divide(p - v, v)) > threshold, v).otherwise(p), 2))


def correct_rolling_median(df: DataFrame, window: int = 3, prediction: str = "y_pred", cols: Cols = COLS) -> DataFrame:
    return df.withColumn(prediction, F.bround(F.percentile(prediction, 0.5).over(cols.trailing(window)), 2))


def correct_ewma(df: DataFrame, span: int = 3, prediction: str = "y_pred", cols: Cols = COLS) -> DataFrame:
    return ewma(df, "_e", 2 / (span + 1), cols, prediction).withColumn(prediction, F.bround("_e", 2)).drop("_e")


def correct_clip(df: DataFrame, stats: DataFrame | None = None, bounds: tuple[float, float] | None = None, prediction: str = "y_pred", cols: Cols = COLS) -> DataFrame:
    """Within the train minimum and maximum of the sensor, or within given bounds."""
    if bounds:
        return df.withColumn(prediction, F.bround(F.greatest(F.lit(bounds[0]), F.least(F.lit(bounds[1]), F.col(prediction))), 2))
    out = df.join(stats.select(cols.sensor, F.col("min").alias("_lo"), F.col("max").alias("_hi")), cols.sensor, "left")
    held = F.when(F.col(prediction).isNotNull(), F.greatest("_lo", F.least("_hi", prediction)))
    return out.withColumn(prediction, F.bround(held, 2)).drop("_lo", "_hi")


def correct_kalman(df: DataFrame, stats: DataFrame, q: float = 1.0, prediction: str = "y_pred", cols: Cols = COLS) -> DataFrame:
    return kalman(df, stats, "_k", q, cols, prediction).withColumn(prediction, F.bround("_k", 2)).drop("_k")


def correct_all(df: DataFrame, stats: DataFrame, threshold: float = 0.5, window: int = 3, span: int = 3, prediction: str = "y_pred", cols: Cols = COLS) -> DataFrame:
    """naive, median, exponential mean, clip."""
    out = correct_rolling_median(correct_naive(df, threshold, prediction, cols), window, prediction, cols)
    return correct_clip(correct_ewma(out, span, prediction, cols), stats, prediction=prediction, cols=cols)


CORRECTIONS = {"naive": correct_naive, "rolling_median": correct_rolling_median, "ewma": correct_ewma, "clip": correct_clip, "kalman": correct_kalman, "all": correct_all}


# Reshaping
def to_wide(df: DataFrame, sensors: list[str], cols: Cols = COLS) -> DataFrame:
    """date x sensor, test_set last. Two readings of one (sensor, date) are an error."""
    if not duplicate_keys(df, cols).isEmpty():
        raise ValueError("duplicate (sensor, date)")
    wide = df.groupBy(cols.date).pivot(cols.sensor, sensors).agg(F.first(cols.value))
    flags = df.groupBy(cols.date).agg(F.max(cols.test).alias(cols.test))
    return wide.join(flags, cols.date).select(cols.date, *sensors, cols.test)


def wide_arrays(df: DataFrame, ordinals: DataFrame, measures: tuple[str, ...] | None = None, by: tuple[str, ...] | None = None, cols: Cols = COLS) -> DataFrame:
    """by..., ``sensors`` (ordinals that have a row) and an array for each measure beside it: a wide table for more sensors than a table has columns.

    ``ordinals``: sensor, sensor_uid from 0, see ``features.fit_ordinal``; sensors without one are left out. Measures default to the value, ``by`` to the date. A row of the
    result is as long as the network is large at its key, and one grouping makes it. Two rows of one (key, sensor) are an error.
    """
    by, measures = list(by or (cols.date,)), list(measures or (cols.value,))
    known = df.join(ordinals.select(F.col(cols.sensor).alias("_s"), F.col("sensor_uid").cast("int").alias("_uid")), F.col(cols.sensor) == F.col("_s"))
    cells = F.array_sort(F.collect_list(F.struct("_uid", *[F.col(m).alias(m) for m in measures])))
    out = known.groupBy(*by).agg(cells.alias("_cells")).withColumn("sensors", F.col("_cells._uid"))
    once = F.size(F.array_distinct("sensors")) == F.size("sensors")
    out = out.withColumn("sensors", F.when(once, F.col("sensors")).otherwise(F.raise_error(F.lit("two rows of one sensor"))))
    return out.select(*by, "sensors", *[F.col(f"_cells.{m}").alias(m) for m in measures])


def dense_arrays(wide: DataFrame, n_sensors: int, measures: tuple[str, ...]) -> DataFrame:
    """``wide_arrays`` with an entry for each of ``n_sensors`` ordinals, null where a sensor has no row, in place of the list of ordinals."""
    schema = T.StructType([T.StructField(f.name, T.ArrayType(T.DoubleType())) if f.name in measures else f for f in wide.schema if f.name != "sensors"])

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            table = pa.Table.from_batches([batch])
            rows, sensors = batch.num_rows, table.column("sensors").combine_chunks()
            at = np.repeat(np.arange(rows), np.diff(sensors.offsets.to_numpy())) * n_sensors + sensors.flatten().to_numpy()
            ends = pa.array(np.arange(rows + 1, dtype=np.int32) * n_sensors)
            out = []
            for f in schema:
                column = table.column(f.name).combine_chunks()
                if f.name in measures:
                    cells = np.full(rows * n_sensors, np.nan)
                    cells[at] = column.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)
                    column = pa.ListArray.from_arrays(ends, pa.array(cells, from_pandas=True))
                out.append(column)
            yield pa.RecordBatch.from_arrays(out, schema.names)

    return wide.mapInArrow(spread, schema)


def sanitize_wide(df: DataFrame, cols: Cols = COLS) -> DataFrame:
    """The datetime column, numeric columns and a boolean test_set."""
    times = [c for c, t in df.dtypes if t.startswith("timestamp") or t == "date"]
    if not times:
        raise ValueError("no datetime column")
    numbers = [c for c, t in df.dtypes if t in ("tinyint", "smallint", "int", "bigint", "float", "double") or t.startswith("decimal")]
    test = [F.col(cols.test).cast("boolean").alias(cols.test)] if cols.test in df.columns else []
    return df.select(F.col(times[0]).alias(cols.date), *[c for c in numbers if c != cols.test], *test)


def melt_external_predictions(wide: DataFrame, sensors: list[str], name: str = "gman_prediction", minutes_per_step: int = 1) -> DataFrame:
    """The last step of each sample, wide to long: sensor_id, {name}, {name}_date, gman_target_date; horizon = steps of a sample."""
    last = wide.agg(F.max("timestep").alias("_hi"), F.min("timestep").alias("_lo"))  # one row
    rows = wide.join(F.broadcast(last), F.col("timestep") == F.col("_hi"))
    pairs = F.explode(F.array(*[F.struct(F.lit(s).alias("sensor_id"), F.col(f"{s}_pred").alias(name)) for s in sensors])).alias("_p")
    horizon = (F.col("_hi") - F.col("_lo") + 1) * minutes_per_step
    long = rows.select(pairs, (F.col("timestamp") - minutes(horizon)).alias(f"{name}_date"), F.col("timestamp").alias("gman_target_date"))
    return long.select("_p.*", f"{name}_date", "gman_target_date")


def predictions_to_wide(df: DataFrame, sensors: list[str], mean: bool = False, order: str | None = None, cols: Cols = COLS) -> DataFrame:
    """date, prediction_time and s, s_pred, s_at_issued_time for each sensor; repeated keys keep the last value in order of the column ``order``, or the mean.

    The last value that is not missing counts, for each measure by itself. Rows of a table have no order of their own, so
    repeated keys need ``order`` or ``mean``.
    """
    keys = [cols.date, "prediction_time", cols.sensor]
    if not mean and order is None and not df.groupBy(*keys).count().filter("count > 1").isEmpty():
        raise ValueError("repeated keys: name the column that orders them, or take the mean")
    best = (lambda c: F.avg(c)) if mean else (lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.col(order)))) if order else (lambda c: F.max(c))
    one = df.groupBy(*keys).agg(best("y").alias("_y"), best("y_pred").alias("_p"), best(cols.value).alias("_v"))
    at = lambda s, c: F.max(F.when(F.col(cols.sensor) == s, F.col(c))).cast("float")
    columns = [x for s in sensors for x in (at(s, "_y").alias(s), at(s, "_p").alias(f"{s}_pred"), at(s, "_v").alias(f"{s}_at_issued_time"))]
    return one.groupBy(cols.date, "prediction_time").agg(*columns)


def concat_parts(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out


# Windows as rows
def _in_chunks(df: DataFrame, before: int, after: int, hours: int, windows: Callable[[DataFrame, WindowSpec], DataFrame], place: bool, cols: Cols) -> DataFrame:
    """``windows`` (rows and a spec to those of their rows whose frames of ``before`` rows back and ``after`` ahead are full) by (sensor, chunk of time).

    Rows are dealt by (sensor, chunk) in one exchange, which is read twice: for the windows inside a chunk, and for the rows at both ends of
    each chunk, which alone are put in order by sensor. Of their windows, those that reach from one chunk into another count: they are shorter
    than the ends are long, so that none of them spans rows that were left out. With ``place``, rows have their place in the series as ``_i``,
    for which the rows of each chunk are counted and the rows dealt once more.
    """
    chunk = F.floor(F.unix_seconds(F.col(cols.date).cast("timestamp")) / (hours * 3600))
    rows = df.select(cols.sensor, cols.date, cols.value, F.coalesce(chunk, F.lit(-(2**60))).alias("_chunk")).repartition(cols.sensor, "_chunk")
    own, series = Window.partitionBy(cols.sensor, "_chunk").orderBy(cols.date, cols.value), Window.partitionBy(cols.sensor).orderBy("_chunk", cols.date, cols.value)
    k = F.row_number().over(own)
    if place:
        counts = rows.groupBy(F.col(cols.sensor).alias("_of"), F.col("_chunk").alias("_at")).agg(F.count("*").alias("_rows"))
        ahead = F.sum("_rows").over(Window.partitionBy("_of").orderBy("_at").rowsBetween(Window.unboundedPreceding, -1))
        starts = counts.select("_of", "_at", F.coalesce(ahead, F.lit(0)).alias("_start"))
        rows = rows.join(starts, F.col(cols.sensor).eqNullSafe(F.col("_of")) & (F.col("_chunk") == F.col("_at"))).drop("_of", "_at").withColumn("_i", F.col("_start") + k - 1)
    reach = before + after
    n = F.count("*").over(own.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    ends = rows.withColumns({"_k": k, "_n": n}).filter((F.col("_k") <= reach) | (F.col("_k") > F.col("_n") - reach))
    ends = ends.withColumns({"_from": F.lag("_chunk", before).over(series), "_to": F.lead("_chunk", after).over(series)})
    across = windows(ends, series).filter(F.col("_from") < F.col("_to")).drop("_k", "_n", "_from", "_to")
    return windows(rows, own).unionByName(across)


def seq_windows(df: DataFrame, length: int, horizon: int, stride: int = 1, delta: bool = True, cols: Cols = COLS, hours: int | None = None) -> DataFrame:
    """sensor, date (window end), target_time, history (length values), target; windows with a null are dropped.

    Ends are the rows length - 1 .. n - horizon - 1 of the sensor by stride. Rows without a date come first, a missing sensor is a series
    of its own. With ``hours``, a chunk of that time is work for one task, however long the series is, and rows of one date are in order of
    value; without, a sensor is, which is quicker where all are short.
    """

    def windows(rows: DataFrame, s: WindowSpec) -> DataFrame:
        out = rows.withColumns(
            {
                "history": F.collect_list(cols.value).over(s.rowsBetween(1 - length, 0)),
                "_t": F.lead(cols.value, horizon).over(s),
                "target_time": F.lead(cols.date, horizon).over(s),
            }
        )
        kept = (F.size("history") == length) & F.col("_t").isNotNull()
        return out.filter(kept if stride == 1 else kept & ((F.col("_i") - (length - 1)) % stride == 0))

    if hours is None:
        s = cols.series()
        out = windows(df if stride == 1 else df.withColumn("_i", F.row_number().over(s) - 1), s)
    else:
        out = _in_chunks(df, length - 1, horizon, hours, windows, stride != 1, cols)
    return out.select(cols.sensor, cols.date, "target_time", "history", (F.col("_t") - F.col(cols.value) if delta else F.col("_t")).alias("target"))


def seq2seq_windows(df: DataFrame, p: int, q: int, cols: Cols = COLS, hours: int | None = None) -> DataFrame:
    """sensor, start, x (p steps), y (the q steps behind them) for every start; order and ``hours`` as in ``seq_windows``."""

    def windows(rows: DataFrame, s: WindowSpec) -> DataFrame:
        out = rows.withColumns({"x": F.collect_list(cols.value).over(s.rowsBetween(0, p - 1)), "y": F.collect_list(cols.value).over(s.rowsBetween(p, p + q - 1))})
        return out.filter((F.size("x") == p) & (F.size("y") == q))

    out = windows(df, cols.series()) if hours is None else _in_chunks(df, 0, p + q - 1, hours, windows, False, cols)
    return out.select(cols.sensor, F.col(cols.date).alias("start"), "x", "y")


def window_split_counts(windows: DataFrame, splits: DataFrame, cols: Cols = COLS) -> DataFrame:
    """split, n_windows by the split of the target time."""
    at = splits.select(F.col(cols.date).alias("target_time"), "split")
    return windows.join(at, "target_time").groupBy("split").agg(F.count("*").alias("n_windows"))


def explode_step_predictions(df: DataFrame, key: list[str]) -> DataFrame:
    """Arrays y and y_pred over steps to one row for each step (timestep from 1)."""
    steps = F.posexplode(F.arrays_zip("y", "y_pred")).alias("_p", "_s")
    return df.select(*key, steps).select(*key, (F.col("_p") + 1).alias("timestep"), F.col("_s.y").alias("y"), F.col("_s.y_pred").alias("y_pred"))


def assemble_results(df: DataFrame, horizon_min: int, delta: bool = True, cols: Cols = COLS) -> DataFrame:
    """Issue time, target time, base value, actual and prediction in absolute space."""
    base, d = F.col(cols.value), F.col(cols.date)
    up = lambda c: F.col(c) + base if delta else F.col(c)
    return df.select(cols.sensor, d.alias("issue_time"), (d + minutes(horizon_min)).alias("target_time"), base.alias("base"), up("y").alias("actual"), up("y_pred").alias("pred"))


def fit_label_scaling(train: DataFrame, column: str = "target", cols: Cols = COLS) -> DataFrame:
    """sensor, mean, std of the targets (population variance, at least 1e-8)."""
    return train.groupBy(cols.sensor).agg(F.avg(column).alias("mean"), F.sqrt(F.greatest(F.var_pop(column), F.lit(1e-8))).alias("std"))


def label_scaling(df: DataFrame, state: DataFrame, column: str = "target", back: bool = False, cols: Cols = COLS) -> DataFrame:
    """{column}_scaled; ``back`` undoes it into {column}."""
    out = df.join(state, cols.sensor, "left")
    x = F.col(f"{column}_scaled") * F.col("std") + F.col("mean") if back else (F.col(column) - F.col("mean")) / F.col("std")
    return out.withColumn(column if back else f"{column}_scaled", x).drop("mean", "std")


def standardize(df: DataFrame, train: DataFrame, columns: list[str], minmax: bool = False) -> DataFrame:
    """z-scores (population std) or 0..1 by the train rows; a column without spread becomes null."""
    ends = [f(c).alias(f"_{k}_{c}") for c in columns for k, f in (("a", F.min if minmax else F.avg), ("b", F.max if minmax else F.stddev_pop))]
    out = df.join(F.broadcast(train.agg(*ends)), F.lit(True))  # one row
    by = lambda c: F.col(f"_b_{c}") - F.col(f"_a_{c}") if minmax else F.col(f"_b_{c}")
    return out.withColumns({c: F.try_divide(F.col(c) - F.col(f"_a_{c}"), by(c)) for c in columns}).drop(*[f"_{k}_{c}" for c in columns for k in "ab"])


def average_ranks(long: DataFrame) -> DataFrame:
    """column, v, rank of the different values v of each column: ranks from 1, ties share their mean rank.

    Values are counted, and the counts are summed in two levels: over ranges of values, found by a sketch, then inside each
    range, so that no task orders a whole column.
    """
    counts = long.groupBy("column", "v").agg(F.count("*").alias("n"))
    bounds = long.groupBy(F.col("column").alias("_c")).agg(F.percentile_approx("v", [i / 64 for i in range(1, 64)]).alias("_b"))  # a row by column
    ranged = counts.join(F.broadcast(bounds), F.col("column") == F.col("_c")).select("column", "v", "n", F.size(F.filter("_b", lambda b: b < F.col("v"))).alias("range"))
    sums = ranged.groupBy("column", "range").agg(F.sum("n").alias("_s"))
    below = F.coalesce(F.sum("_s").over(Window.partitionBy("column").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    inside = F.sum("n").over(Window.partitionBy("column", "range").orderBy("v").rowsBetween(Window.unboundedPreceding, 0))
    return ranged.join(sums.withColumn("_below", below), ["column", "range"]).select("column", "v", (F.col("_below") + inside - (F.col("n") - 1) / 2).alias("rank"))


def correlation_select(df: DataFrame, columns: list[str], threshold: float, method: str = "pearson", cols: Cols = COLS) -> DataFrame:
    """column, correlation of those whose absolute correlation with the value reaches the threshold, over the rows without missing values.

    Pearson's take one pass for all columns; ``spearman`` is the correlation of ranks.
    """
    if method not in ("pearson", "spearman"):
        raise ValueError(f"no method {method}")
    rows = df.select(*dict.fromkeys((*columns, cols.value))).dropna()
    if method == "pearson":
        one = rows.agg(*[F.corr(c, cols.value).alias(c) for c in columns])
        long = one.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("correlation")) for c in columns])).alias("_c")).select("_c.*")
    else:
        cells = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("v")) for c in columns])).alias("_c")
        pairs = rows.select(cells, F.col(cols.value).cast("double").alias("y")).select("_c.*", "y")
        of_y = average_ranks(rows.select(F.lit("y").alias("column"), F.col(cols.value).cast("double").alias("v"))).select(F.col("v").alias("y"), F.col("rank").alias("_y"))
        ranked = pairs.join(average_ranks(pairs.select("column", "v")), ["column", "v"]).join(of_y, "y")
        long = ranked.groupBy("column").agg(F.corr("rank", "_y").alias("correlation"))
    return long.filter(F.abs("correlation") >= threshold)


def keep_correlated(df: DataFrame, columns: list[str], threshold: float, method: str = "pearson", cols: Cols = COLS) -> DataFrame:
    """The keys, the value and the selected columns."""
    kept = {r[0] for r in correlation_select(df, columns, threshold, method, cols).collect()}  # one row for each column at most
    return df.select(cols.sensor, cols.date, cols.value, *[c for c in columns if c in kept])


# Metrics
def _finite(*names: str) -> Column:
    out = F.lit(True)
    for n in names:
        c = F.col(n)
        out &= c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))
    return out


def _absolute(y: Column, p: Column) -> Column:
    return F.abs(y - p)


_METRICS = ("n", "mae", "rmse", "mape", "smape", "mae_std", "median_ae_std", "rmse_std", "mape_std", "smape_std")


def error_metrics(y: Column, p: Column, epsilon: float = 1e-2, drop_zero: bool = False) -> list[Column]:
    """MAE, RMSE, MAPE (x 100, denominator epsilon at least, or zero actuals dropped), SMAPE with their population spreads; all add up from parts."""
    ae, se = _absolute(y, p), (y - p) * (y - p)
    ape = (F.when(y != 0, F.try_divide(ae, F.abs(y))) if drop_zero else ae / F.greatest(F.abs(y), F.lit(epsilon))) * 100
    middle = (F.abs(y) + F.abs(p)) / 2
    smape = F.try_divide(ae, F.when(middle == 0, F.lit(1.0)).otherwise(middle)) * 100
    found = [F.count("*"), F.avg(ae), F.sqrt(F.avg(se)), F.avg(ape), F.avg(smape), F.stddev_pop(ae), F.stddev_pop(ae), F.stddev_pop(se), F.stddev_pop(ape), F.stddev_pop(smape)]
    return [c.alias(x) for x, c in zip(_METRICS, found, strict=True)]


def evaluate_model(df: DataFrame, by: list[str] | None = None, y: str = "y", p: str = "y_pred", epsilon: float = 1e-2, drop_zero: bool = False, accuracy: int | None = None) -> DataFrame:
    """One row (or one by group) over the rows with finite truth and prediction: median absolute error and ``error_metrics``.

    The median is exact and found by rank, without a task that holds all errors; with ``accuracy`` it is that of a mergeable sketch.
    """
    by, rows = by or [], df.filter(_finite(y, p))
    metrics = error_metrics(F.col(y), F.col(p), epsilon, drop_zero)
    if accuracy:
        out = rows.groupBy(*by).agg(*metrics, F.percentile_approx(_absolute(F.col(y), F.col(p)), 0.5, accuracy).alias("median_ae"))
    else:
        named = dict(zip(_METRICS, metrics, strict=True))
        out = exact_quantiles(rows, _absolute(F.col(y), F.col(p)), {"median_ae": 0.5}, by, more=named).withColumn("n", F.coalesce("n", F.lit(0).cast("long")))
    return out.select(*by, "n", "mae", "median_ae", *_METRICS[2:])


def evaluate_naive(df: DataFrame, by: list[str] | None = None, y: str = "y", accuracy: int | None = None, cols: Cols = COLS) -> DataFrame:
    """The same for persistence: the current value is the prediction."""
    return evaluate_model(df, by, y, cols.value, accuracy=accuracy)


def mape_zero_handling(df: DataFrame, epsilon: float = 1e-2, y: str = "y", p: str = "y_pred") -> DataFrame:
    """One row: mape_discard (rows with truth 0 dropped) and mape_epsilon (its size is epsilon at least)."""
    t, ae = F.col(y), F.abs(F.col(y) - F.col(p))
    return df.filter(_finite(y, p)).agg((F.avg(F.when(t != 0, F.try_divide(ae, F.abs(t)))) * 100).alias("mape_discard"), (F.avg(ae / F.greatest(F.abs(t), F.lit(epsilon))) * 100).alias("mape_epsilon"))


def zero_share(df: DataFrame, y: str = "y") -> DataFrame:
    return df.agg((F.avg((F.col(y) == 0).cast("double")) * 100).alias("zero_percent"))


def series_metrics(df: DataFrame, by: list[str] | None = None, y: str = "y", p: str = "y_pred") -> DataFrame:
    """The second definition: MAPE without zero actuals; SMAPE 2 ae / (|a| + |p| + 1e-12)."""
    t, q = F.col(y), F.col(p)
    ae = F.abs(t - q)
    return df.filter(_finite(y, p)).groupBy(*(by or [])).agg(
        F.avg(ae).alias("mae"), F.sqrt(F.avg(ae * ae)).alias("rmse"), (F.avg(F.when(t != 0, F.try_divide(ae, F.abs(t)))) * 100).alias("mape"),
        (F.avg(2 * ae / (F.abs(t) + F.abs(q) + F.lit(1e-12))) * 100).alias("smape"),
    )


def metrics_by_sensor(df: DataFrame, cols: Cols = COLS) -> DataFrame:
    """Those metrics by sensor, and their unweighted mean as sensor 'all'."""
    each = series_metrics(df, [cols.sensor])
    whole = each.agg(*[F.avg(c).alias(c) for c in ("mae", "rmse", "mape", "smape")]).withColumn(cols.sensor, F.lit("all"))
    return each.unionByName(whole)


def metrics_by_step(df: DataFrame) -> DataFrame:
    """Masked MAE, RMSE and MAPE (over non-zero labels, MAPE by the signed label) by step, with the mean over steps as step -1."""
    t, ae = F.col("y"), F.abs(F.col("y") - F.col("y_pred"))
    each = df.filter("y <> 0").groupBy("timestep").agg(F.avg(ae).alias("mae"), F.sqrt(F.avg(ae * ae)).alias("rmse"), F.avg(F.try_divide(ae, t)).alias("mape"))
    return each.unionByName(each.agg(F.lit(-1).alias("timestep"), *[F.avg(c).alias(c) for c in ("mae", "rmse", "mape")]))


def metrics_plain(df: DataFrame) -> DataFrame:
    """Unmasked MAE, RMSE, MAPE."""
    t, ae = F.col("y"), F.abs(F.col("y") - F.col("y_pred"))
    return df.agg(F.avg(ae).alias("mae"), F.sqrt(F.avg(ae * ae)).alias("rmse"), F.avg(F.try_divide(ae, t)).alias("mape"))


def compare_corrections(before: DataFrame, after: DataFrame, accuracy: int | None = None) -> DataFrame:
    """Metrics by variant (raw, corrected)."""
    both = before.select(F.lit("raw").alias("variant"), "y", "y_pred").unionByName(after.select(F.lit("corrected").alias("variant"), "y", "y_pred"))
    return evaluate_model(both, ["variant"], accuracy=accuracy)


def compare_models(df: DataFrame, accuracy: int | None = None) -> DataFrame:
    """Metrics by model and horizon."""
    return evaluate_model(df, ["model", "horizon"], accuracy=accuracy)


def metrics_long(metrics: DataFrame, kind: str, keys: list[str] | None = None) -> DataFrame:
    """Metric columns as rows: type, keys, metric, value."""
    names = [c for c in metrics.columns if c not in (keys or [])]
    long = metrics.select(*(keys or []), *[F.col(c).cast("double").alias(c) for c in names]).unpivot(keys or [], names, "metric", "value")
    return long.withColumn("type", F.lit(kind))

