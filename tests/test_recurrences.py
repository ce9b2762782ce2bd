"""Exponential means and the Kalman smoother over many chunks: equal to one sequential pass, in one exchange of rows."""

from datetime import datetime, timedelta

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from roadspeed.functions import kernels
from roadspeed.operators import features, predict

START = datetime(2024, 1, 1)
SCHEMA = "sensor_id string, date timestamp, value double, note string"


def series(seed, n, gaps):
    rng = np.random.default_rng(seed)
    x = rng.uniform(5, 90, n)
    x[rng.random(n) < gaps] = np.nan
    return x


def frame(spark, by_sensor, step=timedelta(hours=1)):
    rows = [(s, START + i * step, None if np.isnan(v) else float(v), f"{s}{i}") for s, x in by_sensor.items() for i, v in enumerate(x)]
    return spark.createDataFrame(rows, SCHEMA).repartition(7)


def column(df, sensor, name):
    rows = df.filter(F.col("sensor_id").eqNullSafe(F.lit(sensor))).orderBy("date").select(name).collect()
    return np.array([np.nan if r[0] is None else r[0] for r in rows], float)


def sensors():
    """A hot sensor of some fifty chunks, one with long gaps, one that starts late, one without values, one of a row, one without a name."""
    late = series(3, 700, 0.0)
    late[:450] = np.nan
    return {"hot": series(1, 1250, 0.02), "gaps": series(2, 600, 0.97), "late": late, "none": np.full(120, np.nan), "one": np.array([7.0]), None: series(4, 200, 0.3)}


def exchanges(df):
    """Shuffles of rows that ran, of those by sensor and chunk, and reads of one that ran already."""
    df.collect()
    text = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    return sum("Exchange hashpartitioning(_series" in line and "_chunk" in line and "Reused" not in line and "REPARTITION_BY_COL" in line for line in text.splitlines()), text.count("ReusedExchange")


def test_affine_scan():
    rng = np.random.default_rng(0)
    for n in (0, 1, 2, 17, 1000):
        a, b = rng.uniform(-1, 1, n), rng.uniform(-9, 9, n)
        a[rng.random(n) < 0.1] = 0
        a[rng.random(n) < 0.2] = 1
        expected, y = [], 0.0
        for i in range(n):
            y = b[i] + (a[i] * y if i else 0.0)
            expected.append(y)
        assert kernels.affine_scan(a, b) == pytest.approx(expected, abs=1e-9)


@pytest.mark.parametrize("alpha", [0.5, 1 - 0.5**0.2, 0.01, 1.0])
def test_means_over_chunks_are_those_of_one_pass(spark, alpha):
    whole = sensors()
    out = kernels.ewmas(frame(spark, whole), {"e": alpha, "f": 0.3}, steps={"e": "change"}, hours=24).persist()
    assert out.count() == sum(map(len, whole.values()))
    for s, x in whole.items():
        expected = pd.Series(x).ewm(alpha=alpha, adjust=False, ignore_na=False).mean()
        assert column(out, s, "e") == pytest.approx(expected.to_numpy(), nan_ok=True, rel=1e-12)
        assert column(out, s, "change") == pytest.approx(expected.diff().to_numpy(), nan_ok=True, abs=1e-10)
        assert column(out, s, "f") == pytest.approx(pd.Series(x).ewm(alpha=0.3, adjust=False, ignore_na=False).mean().to_numpy(), nan_ok=True, rel=1e-12)
    assert out.filter("note is null").isEmpty()
    out.unpersist()


def test_a_hot_sensor_is_work_for_many_tasks_in_one_exchange(spark):
    df = frame(spark, {"hot": series(1, 1250, 0.02)})
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        assert kernels.Chunks(df, 24, predict.COLS).rows.select(F.spark_partition_id().alias("p")).distinct().count() > 1
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    fresh, again = exchanges(features.ewma_mean_slope(df, hours=24))
    assert (fresh, again) == (1, 1)
    stats = spark.createDataFrame([("hot", 40.0, 90.0)], "sensor_id string, mean double, var double")
    fresh, again = exchanges(kernels.kalman(df, stats, "k", hours=24))
    assert fresh == 1 and again >= 2


def smoothed(x, mean, var, q):
    """Filter and Rauch-Tung-Striebel smoother, row by row."""
    y = pd.Series(x).ffill().bfill().to_numpy()
    m, p, ms, ps = mean, var, [], []
    for i, v in enumerate(y):
        ahead = p if not i else p + q
        gain = ahead / (ahead + var) if ahead + var else 0.0
        m, p = m + gain * (v - m), ahead * (1 - gain)
        ms.append(m)
        ps.append(p)
    s = [ms[-1]]
    for i in range(len(y) - 2, -1, -1):
        c = ps[i] / (ps[i] + q) if ps[i] + q else 0.0
        s.append(ms[i] + c * (s[-1] - ms[i]))
    return np.array(s[::-1])


@pytest.mark.parametrize("q", [1.0, 0.0, 1e-7, 500.0])
def test_smoother_over_chunks_is_that_of_one_pass(spark, q):
    whole = {s: x for s, x in sensors().items() if s not in ("none", None)}
    stats = {"hot": (40.0, 90.0), "gaps": (50.0, 9.0), "late": (10.0, 0.0), "one": (3.0, 4.0)}
    df = frame(spark, whole | {"unknown": series(5, 50, 0.1)})
    table = spark.createDataFrame([(s, *v) for s, v in stats.items()] + [(None, 1.0, 1.0)], "sensor_id string, mean double, var double")
    out = kernels.kalman(df, table, "k", q, hours=24).persist()
    assert out.count() == sum(map(len, whole.values()))
    for s, x in whole.items():
        assert column(out, s, "k") == pytest.approx(smoothed(x, *stats[s], q), rel=1e-9)
    out.unpersist()


def test_variances_jump_to_any_row():
    for var, q in ((100.0, 1.0), (1e-3, 50.0), (400.0, 1e-9), (5.0, 0.0), (1.0, 1e20), (2.0, 1.0), (0.0, 1.0)):
        got, p = kernels.variances(np.arange(1, 2000), np.full(1999, var), q), var / 2
        for i in range(1999):
            p = (p + q) * var / (p + q + var) if i and p + q + var else p
            assert got[i] == pytest.approx(p, rel=1e-11)


def test_odd_rows_and_tables(spark):
    empty = spark.createDataFrame([], SCHEMA)
    stats = spark.createDataFrame([("A", 40.0, 90.0)], "sensor_id string, mean double, var double")
    assert kernels.ewma(empty, "e", 0.5).collect() == [] and kernels.kalman(empty, stats, "k").collect() == []
    numbers = spark.createDataFrame([(1, START, 3), (1, START + timedelta(days=400), None), (1, None, 9), (2, START, 4)], "sensor_id int, date timestamp, value int")
    out = kernels.ewma(numbers, "e", 0.5)
    assert dict(out.dtypes)["sensor_id"] == "int"
    assert sorted((r.sensor_id, str(r.date), r.e) for r in out.collect()) == sorted([(1, "None", 9.0), (1, str(START), 6.0), (1, str(START + timedelta(days=400)), 6.0), (2, str(START), 4.0)])


def test_rows_of_a_block_of_any_size(spark, monkeypatch):
    whole = sensors()
    df = frame(spark, whole)
    expected = {s: column(kernels.ewma(df, "e", 0.2, hours=24), s, "e") for s in ("hot", "gaps")}
    out = kernels.ewma(df, "e", 0.2, hours=10**6).persist()  # a chunk by sensor
    for s, e in expected.items():
        assert column(out, s, "e") == pytest.approx(e, nan_ok=True, rel=1e-12)
    out.unpersist()
