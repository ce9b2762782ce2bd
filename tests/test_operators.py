"""Operators on small hand-made frames; expected values from pandas or by hand."""

from datetime import datetime, timedelta

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from roadspeed.functions.kernels import ewma
from roadspeed.operators import clean, features, graph, predict, shape, split

START = datetime(2024, 1, 1)
SCHEMA = "sensor_id string, date timestamp, value double"


def frame(spark, values, sensor="A", start=START, step=timedelta(hours=1)):
    return spark.createDataFrame([(sensor, start + i * step, v) for i, v in enumerate(values)], SCHEMA)


def column(df, name):
    return [r[name] for r in df.orderBy("sensor_id", "date").select(name).collect()]


def test_clean_value(spark):
    texts = ["101 315", "1 000,5", "101 . 315", "55.678", "n/a", None, "7"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    assert [r.v for r in df.orderBy("i").select(clean.clean_value(F.col("t")).alias("v")).collect()] == [101.32, None, None, 55.68, None, None, 7.0]


def test_relative_change_pads_gaps_and_marks_infinity(spark):
    change, infinite = clean.relative_change()
    df = frame(spark, [10.0, None, 30.0, 0.0, 5.0, 0.0, 0.0]).withColumns({"c": change, "x": infinite})
    assert column(df, "c") == [None, 0.0, 2.0, -1.0, None, -1.0, None]
    assert column(df, "x") == [None, False, False, False, True, False, False]


def test_interpolation_is_by_row(spark):
    values = [None, 1.0, None, None, 4.0, None, 8.0, None]
    expected = pd.Series(values, dtype=float).interpolate().ffill().bfill().tolist()
    assert column(clean.interpolate_gaps(frame(spark, values)), "value") == pytest.approx(expected)
    assert column(clean.interpolate_gaps(frame(spark, [None, None])), "value") == [None, None]


def test_smoothing_restarts_at_the_boundary(spark):
    df = frame(spark, [1.0, 2.0, 3.0, 10.0, 20.0]).withColumn("test_set", F.col("date") >= START + timedelta(hours=3))
    assert column(clean.smooth_train_test_separately(df, 3), "value") == pytest.approx([1, 1.5, 2, 10, 15])
    assert column(clean.smooth_speeds(df, 4, median=True), "value") == pytest.approx([1, 1.5, 2, 2.5, 6.5])


def test_align_timeframe_takes_the_smallest_id_on_a_tie(spark):
    df = frame(spark, [1.0] * 5).unionByName(frame(spark, [2.0] * 2, "C")).unionByName(frame(spark, [3.0] * 2, "B", START + timedelta(hours=2)))
    assert column(clean.align_timeframe(df), "sensor_id") == ["A", "A", "B", "B"]


def test_boundaries(spark):
    df = split.flag_test_set(frame(spark, [0.0] * 10), 1 / 3)
    assert column(df, "test_set") == [False] * 6 + [True] * 4
    assert column(split.flag_test_set(frame(spark, [0.0]), 1.0), "test_set") == [True]
    assert column(split.ts_folds(frame(spark, [0.0] * 10), 3), "fold") == [0] * 4 + [1, 1, 2, 2, 3, 3]
    flagged = frame(spark, [0.0] * 10).withColumn("test_set", F.lit(False))
    assert [r.split for r in split.target_splits(flagged).orderBy("idx").collect()] == ["train"] * 6 + ["val"] * 2 + ["test"] * 2


def test_lags_and_target(spark):
    df = frame(spark, [10.0, 20.0, 0.0])
    assert column(features.lag_features(df, 1), "relative_diff_lag1") == pytest.approx([-1, 10 / 10.00001, -20 / 20.00001])
    assert column(features.lag_features(df, 1, relative=False), "diff_lag1") == [-1, -10, 20]
    out = features.create_target(df, 2)
    assert column(out, "target") == [-10]
    assert column(out, "prediction_time") == [START + timedelta(hours=2)]


def test_momentum_against_pandas(spark):
    values = np.random.default_rng(1).integers(0, 90, 30).astype(float).tolist()
    df, s = frame(spark, values), pd.Series(values)
    slope = s.rolling(5).apply(lambda x: np.polyfit(range(5), x, 1)[0]).fillna(-1)
    assert column(features.rolling_slope(df, (5,)), "slope_5") == pytest.approx(slope.tolist())
    mad = s.rolling(10).apply(lambda x: np.median(np.abs(x - np.median(x)))).fillna(-1)
    out = features.rolling_volatility(df, 10)
    assert column(out, "mad_10") == pytest.approx(mad.tolist())
    assert column(out, "std_10") == pytest.approx(s.rolling(10).std().fillna(-1).tolist())
    ext = features.rolling_extrema(df, 4)
    assert column(ext, "dist_to_min_4")[:2] == [values[0] + 1, values[1] + 1]
    low = features.minutes_since_below(df, 0.0, 5)
    assert column(low, "minutes_since_below") == [-1] * 30


def test_ewma_with_a_gap(spark):
    assert column(ewma(frame(spark, [1.0, 2.0, None, 4.0, 5.0]), "e", 0.5), "e") == pytest.approx([1, 1.5, 1.5, 19 / 6, 49 / 12])


def test_neighbours(spark):
    df = frame(spark, [10.0, 20.0]).unionByName(frame(spark, [30.0], "B"))
    edges = spark.createDataFrame([("A", "down", 1, "B", 500.0), ("A", "up", 1, None, None), ("B", "down", 1, None, None)], "sensor_id string, direction string, k int, neighbor_id string, distance double")
    out = graph.adjacent_values(df, edges, 1)
    assert column(out, "downstream_sensor_1") == [30.0, -1.0, -1.0]
    assert column(out, "upstream_sensor_1") == [-1.0] * 3
    assert [r.sensor_id for r in graph.missing_neighbors(df, edges).collect()] == ["B"]


def test_previous_weekday_falls_back_on_sundays(spark):
    days = [START + timedelta(days=i) for i in (4, 5, 6, 7)]  # Friday to Monday
    df = spark.createDataFrame([("A", t + timedelta(hours=h), float(i * 10 + h)) for i, t in enumerate(days) for h in (0, 1)], SCHEMA)
    out = graph.previous_weekday_window(df, 60, 0, 0)
    by = {r.date: r["prev_wd_val_t0"] for r in out.collect()}
    assert by[days[2]] == 11.0  # Sunday: no value a week before, so Saturday
    assert by[days[3]] == 1.0  # Monday: Friday
    assert by[days[1]] is None


def test_corrections_and_metrics(spark):
    df = spark.createDataFrame([("A", START + timedelta(hours=i), v, p, y) for i, (v, p, y) in enumerate([(10.0, 16.0, 10.0), (10.0, 14.0, 0.0), (0.0, 5.0, 5.0)])], SCHEMA + ", y_pred double, y double")
    assert column(predict.correct_naive(df), "y_pred") == [10.0, 14.0, 5.0]
    m = predict.evaluate_model(df).first()
    assert (m.mae, m.median_ae) == pytest.approx((20 / 3, 6.0))
    assert m.mape == pytest.approx((60 + 140_000 + 0) / 3)
    assert predict.mape_zero_handling(df).first().mape_discard == pytest.approx(30.0)
    stats = spark.createDataFrame([("A", 11.0, 15.0)], "sensor_id string, min double, max double")
    assert column(predict.correct_clip(df, stats), "y_pred") == [15.0, 14.0, 11.0]


def test_wide_refuses_duplicates(spark):
    df = frame(spark, [1.0, 2.0]).withColumn("test_set", F.lit(False))
    assert predict.to_wide(df, ["A"]).count() == 2
    with pytest.raises(ValueError, match="duplicate"):
        predict.to_wide(df.unionByName(df), ["A"])


def test_windows(spark):
    out = predict.seq_windows(frame(spark, [1.0, 2.0, None, 4.0, 5.0, 6.0, 7.0]), 2, 1)
    assert [list(r.history) for r in out.orderBy("date").collect()] == [[4.0, 5.0], [5.0, 6.0]]
    out = predict.seq2seq_windows(frame(spark, [1.0, 2.0, 3.0, 4.0]), 2, 1)
    assert [(list(r.x), list(r.y)) for r in out.orderBy("start").collect()] == [([1.0, 2.0], [3.0]), ([2.0, 3.0], [4.0])]


def test_types(spark):
    df = spark.createDataFrame([(1, 300, 2.5, True)], "hour bigint, n bigint, v double, is_x boolean")
    assert dict(shape.enforce_dtypes(df).dtypes) == {"hour": "tinyint", "n": "smallint", "v": "float", "is_x": "boolean"}
    assert dict(shape.optimize_dtypes(df).dtypes) == {"hour": "tinyint", "n": "smallint", "v": "float", "is_x": "boolean"}
    assert shape.align_to_features(df, ["v", "none"]).first() == (2.5, 0.0)


def test_empty_tables(spark):
    none = frame(spark, [])
    for out in (clean.filter_extremes(none), split.flag_test_set(none), features.lag_features(none, 2), features.rolling_volatility(none), clean.align_timeframe(none)):
        assert out.count() == 0


def test_wide_tables_of_ten_thousand_sensors(spark):
    """Ordinals and values in arrays, sparse and dense; a null value and an absent row differ in the sparse form only."""
    n = 10_000
    df = spark.range(3 * n).select(F.format_string("X%05d", F.col("id") % n).alias("sensor_id"), F.timestamp_seconds(F.floor(F.col("id") / n) * 3600).alias("date"), (F.col("id") * 1.0).alias("value"))
    df = df.filter("sensor_id <> 'X00003' or date > '1970-01-01 00:30:00'").withColumn("value", F.when(F.col("sensor_id") != "X00007", F.col("value")))
    sparse = predict.wide_arrays(df, features.fit_ordinal(df))
    assert [len(r.sensors) for r in sparse.orderBy("date").collect()] == [n - 1, n, n]
    dense = predict.dense_arrays(sparse, n, ("value",)).orderBy("date").collect()
    expected = [[float(h * n + i) if i != 7 and (i != 3 or h) else None for i in range(n)] for h in range(3)]
    assert [r.value for r in dense] == expected
    with pytest.raises(Exception, match="two rows"):
        predict.wide_arrays(df.unionByName(df), features.fit_ordinal(df)).collect()
    empty = predict.wide_arrays(df.limit(0), features.fit_ordinal(df))
    assert empty.collect() == [] and predict.dense_arrays(empty, n, ("value",)).collect() == []
    both = predict.wide_arrays(df.withColumn("y_pred", F.col("value") + 1), features.fit_ordinal(df), ("value", "y_pred"))
    assert both.columns == ["date", "sensors", "value", "y_pred"]
