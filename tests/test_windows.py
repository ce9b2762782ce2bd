"""Sequence windows in chunks of time: equal to plain loops for any chunk, in one exchange of rows."""

from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from roadspeed import queries
from roadspeed.operators import predict

START = datetime(2024, 1, 5)


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    """A long and some short sensors with gaps, nulls, equal dates, missing dates and a missing sensor."""
    rng, path = np.random.default_rng(3), str(tmp_path_factory.mktemp("windows"))
    rows = [("S0", START + timedelta(hours=i), float(i) if rng.random() > 0.03 else None) for i in range(3000) if rng.random() > 0.1]
    rows += [(f"S{k}", START + timedelta(hours=97 * i), float(i)) for k in range(1, 4) for i in range(9 * k)]
    rows += [(None, START + timedelta(hours=i), float(i)) for i in range(12)] + [("S1", None, 7.0), ("S1", None, 3.0), ("S2", START, -1.0), ("S2", START, -1.0)]
    spark.createDataFrame(rows, "sensor_id string, date timestamp, value double").write.parquet(f"{path}/rows")
    return spark.read.parquet(f"{path}/rows"), rows


def series(rows):
    out = {}
    for sensor, date, value in rows:
        out.setdefault(sensor, []).append((date is not None, date or START, value is not None, value if value is not None else 0.0))
    return {s: [(d if known else None, v if there else None) for known, d, there, v in sorted(held)] for s, held in out.items()}


def key(row):
    return tuple((x is not None, str(x)) for x in row)


def loop(rows, length, horizon, stride):
    for sensor, held in series(rows).items():
        for i in range(length - 1, len(held) - horizon, stride):
            history = [v for _, v in held[i - length + 1 : i + 1]]
            if None not in history and held[i + horizon][1] is not None:
                yield sensor, held[i][0], held[i + horizon][0], history, held[i + horizon][1] - held[i][1]


@pytest.mark.parametrize(("length", "horizon", "stride", "hours"), [(4, 2, 1, 720), (5, 3, 4, 24), (1, 1, 1, 5), (60, 7, 1, 10), (3, 0, 2, 100)])
def test_windows_equal_a_loop(stored, length, horizon, stride, hours):
    df, rows = stored
    found = [(r.sensor_id, r.date, r.target_time, list(r.history), r.target) for r in predict.seq_windows(df, length, horizon, stride, hours=hours).collect()]
    assert sorted(found, key=key) == sorted(loop(rows, length, horizon, stride), key=key)


def test_pieces_of_a_chunk(stored, monkeypatch):
    df, rows = stored
    monkeypatch.setattr(predict, "PIECE_ROWS", 7)
    found = [(r.sensor_id, r.date, r.target_time, list(r.history), r.target) for r in predict.seq_windows(df, 10, 4, hours=720).collect()]
    assert sorted(found, key=key) == sorted(loop(rows, 10, 4, 1), key=key)


@pytest.mark.parametrize("hours", [720, 13])
def test_seq2seq_equals_a_loop(stored, hours):
    df, rows = stored
    expected = []
    for sensor, held in series(rows).items():
        for i in range(len(held) - 7):
            values = [v for _, v in held[i : i + 8]]
            if None not in values:
                expected.append((sensor, held[i][0], values[:5], values[5:]))
    found = [(r.sensor_id, r.start, list(r.x), list(r.y)) for r in predict.seq2seq_windows(df, 5, 3, hours=hours).collect()]
    assert sorted(found, key=key) == sorted(expected, key=key)


def test_empty(stored):
    df, _ = stored
    assert predict.seq_windows(df.filter("false"), 4, 2, hours=24).collect() == []


def test_rows_are_shuffled_once(stored):
    df, _ = stored
    out = predict.seq_windows(df, 60, 3, hours=720)
    out.collect()
    plan = out._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert plan.count("ReusedExchange") == 1
    assert plan.count("FileScan parquet") == 1


def test_no_sensor_beside_one_named_like_it(spark):
    """A missing sensor and one named as the null byte are two series, though both have rows in every chunk."""
    rows = [(s, START + timedelta(hours=7 * i + k), float(i + 100 * k)) for k, s in enumerate((None, "\x00")) for i in range(40)]
    df = spark.createDataFrame(rows, "sensor_id string, date timestamp, value double")
    found = [(r.sensor_id, r.date, r.target_time, list(r.history), r.target) for r in predict.seq_windows(df, 5, 2, hours=24).collect()]
    assert sorted(found, key=key) == sorted(loop(rows, 5, 2, 1), key=key)


@pytest.mark.parametrize("op", [lambda df: predict.seq_windows(df, 60, 3, hours=720), lambda df: predict.seq2seq_windows(df, 5, 3, hours=720)])
def test_no_arrays_of_chunks(stored, op):
    """Windows are frames of rows that are sorted once: no chunk is gathered into an array, and none is joined with what its neighbours hold."""
    out = op(stored[0])
    out.collect()
    plan = out._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert "Aggregate" not in plan and "Join" not in plan and "Generate" not in plan
    assert plan.count("ReusedExchange") == 1 and plan.count("FileScan parquet") == 1


@pytest.mark.parametrize(("length", "horizon", "stride", "hours"), [(1, 0, 1, 24), (1, 0, 3, 24), (2, 9, 7, 6), (8, 1, 5, 1)])
def test_windows_over_many_short_chunks(stored, length, horizon, stride, hours):
    df, rows = stored
    found = [(r.sensor_id, r.date, r.target_time, list(r.history), r.target) for r in predict.seq_windows(df, length, horizon, stride, hours=hours).collect()]
    assert sorted(found, key=key) == sorted(loop(rows, length, horizon, stride), key=key)


def test_text_of_values(spark):
    """The queries' text of a value is that of %.4f, by either way."""
    rng = np.random.default_rng(5)
    values = [0.0, -0.0, 0.001, -0.001, 0.00005, -0.00004, 0.0012345, 1.00005, 1.0, 1e6, 1e6 + 0.5, 123456.78905, 1e15, -1e20, float("nan"), float("inf"), None, 2.5, 0.3]
    values += [float(x) for x in np.exp(rng.uniform(-9, 16, 3000)) * rng.choice([-1, 1], 3000)] + [k / 1e4 for k in range(1, 3000, 7)] + [k + 0.00005 for k in range(300)]
    df = spark.createDataFrame([([v],) for v in values], "v array<double>").withColumn("at", F.monotonically_increasing_id()).orderBy("at")
    assert [r.v for r in queries._hist(df, "v").collect()] == [r.t for r in df.select(F.format_string("%.4f", F.get("v", F.lit(0))).alias("t")).collect()]
