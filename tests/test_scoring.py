"""Stored scorers and streams against the same work on whole tables; recurrences over small batches against whole series."""

import numpy as np
import pandas as pd
import pytest
from pyspark.ml import PipelineModel
from pyspark.sql import functions as F

from roadspeed.functions import kernels
from roadspeed.operators import base, features, predict, shape
from roadspeed.plans import jobs
from roadspeed.sources import io, tables
from roadspeed.streaming import stream

SF = "/root/testdata/sf0.001"


def plain(df):
    return sorted(tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in df.collect())


def test_stored_scorer_equals_the_training_table(spark, tmp_path):
    """New rows scored from states and history alone get what the table with all rows gives them."""
    df = tables.readings_split(spark, SF)
    edges = tables.edges(spark, df)
    config = jobs.BuildConfig(lags=6)
    jobs.fit_scorer(df, edges, str(tmp_path / "s"), horizon=1, config=config, max_iter=3)
    scorer = jobs.load_scorer(spark, str(tmp_path / "s"))
    assert scorer.config == config
    whole = jobs.features_for_horizon(jobs.base_features(df, edges, config), 1, config).filter("test_set")
    expected = predict.prediction_frame(jobs.batch_score(scorer.model, whole, scorer.names), "prediction", 60)
    found = jobs.score_rows(df.filter("test_set").drop("test_set"), scorer)
    assert plain(found) == plain(expected.select(*found.columns))
    assert found.count() == df.filter("test_set").count()


def test_new_rows_that_are_known_or_have_no_history(spark, tmp_path):
    df = tables.readings_split(spark, SF)
    config = jobs.BuildConfig(lags=6)
    jobs.fit_scorer(df, tables.edges(spark, df), str(tmp_path / "s"), config=config, max_iter=2)
    scorer, new = jobs.load_scorer(spark, str(tmp_path / "s")), df.filter("test_set").drop("test_set")
    plain_rows = plain(jobs.score_rows(new, scorer))
    known = scorer.history.select("sensor_id", "date", "value").limit(20)
    assert plain(jobs.score_rows(new.unionByName(known), scorer)) == plain_rows
    stranger = new.filter("sensor_id = 'S00'").withColumn("sensor_id", F.lit("S99")).orderBy("date").limit(9)
    both = jobs.score_rows(new.unionByName(stranger), scorer)
    assert both.filter("sensor_id = 'S99'").count() == 9
    warm = jobs.score_rows(new.unionByName(stranger), scorer, warm_up=True)
    assert warm.filter("sensor_id = 'S99'").count() == 3
    assert plain(warm.filter("sensor_id <> 'S99'")) == plain_rows


def test_streaming_model_equals_the_table(spark, tmp_path):
    """Three arrivals with late and repeated rows, a restart before each: the rows in order are scored as on a table."""
    df = tables.readings_split(spark, SF)
    stream.fit_stream_model(df.filter("not test_set"), str(tmp_path / "m"), lags=2)
    model = PipelineModel.load(str(tmp_path / "m"))
    rows = stream._hours(spark, SF)
    found = stream.run_arrivals(rows, lambda s: stream.stream_model_score(s, model), str(tmp_path / "r"))
    kept, top = in_time(rows)
    assert rows.select("sensor_id", "date").distinct().count() > len(kept) > 700
    table = stream.lag_table(spark.createDataFrame(kept, SCHEMA), 2).filter(F.col("date") <= F.lit(top) - F.expr("interval 1 day"))
    scored = jobs.batch_score(model, stream.model_features(table, 2), stream.model_names(2))
    assert plain(found) == plain(predict.prediction_frame(scored, "prediction", 60).select(*found.columns))


SCHEMA = "sensor_id string, date timestamp, value double"


def in_time(rows, late="1 day"):
    """Rows that the watermark of the slices before has not passed, each once; the newest date."""
    kept, top = {}, None
    for _, part in rows.toPandas().groupby("slice"):
        passed = top - pd.Timedelta(late) if top is not None else None
        for r in part.itertuples():
            if passed is None or r.date > passed:
                kept.setdefault((r.sensor_id, r.date.to_pydatetime()), r.value)
        top = part.date.max() if top is None else max(top, part.date.max())
    return [(*k, v) for k, v in kept.items()], top.to_pydatetime()


def test_state_of_a_silent_sensor_expires(spark, tmp_path):
    day = lambda n: (pd.Timestamp("2024-01-01") + pd.Timedelta(days=n)).to_pydatetime()
    rows = [("a", day(0), 1.0, 0), ("a", day(1), 2.0, 0), ("a", day(2), 3.0, 0), ("b", day(60), 1.0, 1), ("a", day(61), 4.0, 2), ("a", day(62), 5.0, 2), ("a", day(63), 6.0, 2), ("b", day(70), 2.0, 2)]
    df = spark.createDataFrame(rows, SCHEMA + ", slice int")
    found = stream.run_arrivals(df, lambda s: stream.stream_lags(s, 2), str(tmp_path / "x"))
    assert [(r.date, r.lag1, r.lag2) for r in found.orderBy("date").collect()] == [(day(2), 2.0, 1.0), (day(63), 5.0, 4.0)]


def test_rows_in_any_order_within_the_watermark_give_the_result_of_the_table(spark, tmp_path):
    r = np.random.default_rng(5)
    hour = lambda n: (pd.Timestamp("2024-01-01") + pd.Timedelta(hours=int(n))).to_pydatetime()
    rows = []
    for i in range(96):
        late = int(r.integers(0, 20))  # up to 20 hours late: inside the day that the stream waits
        rows += [(s, hour(i), None if (i + len(s)) % 17 == 0 else float(r.integers(0, 90)), (i + late) // 24) for s in ("a", "bb", "ccc")]
    rows += rows[5:20]  # some come twice
    rows += [("a", hour(150), 1.0, 5), ("dddd", None, 2.0, 0)]
    df = spark.createDataFrame(rows, SCHEMA + ", slice int")
    before = spark.conf.get(stream._STORE)
    found = stream.run_arrivals(df, lambda s: stream.stream_lags(s, 3), str(tmp_path / "x"), 6)
    assert spark.conf.get(stream._STORE) == before
    table = stream.lag_table(df.filter("date is not null").dropDuplicates(["sensor_id", "date"]), 3).filter(F.col("date") <= hour(126))
    assert found.count() == 3 * 93
    assert plain(found) == plain(table.select(*found.columns)) or sorted(map(str, found.collect())) == sorted(map(str, table.select(*found.columns).collect()))
    ordered = stream.run_arrivals(df, stream.stream_in_order, str(tmp_path / "y"), 6)
    assert ordered.count() == 3 * 96 and ordered.columns == ["sensor_id", "date", "value"]


def test_stream_with_all_features_equals_scoring_a_table(spark, tmp_path):
    """The stored scorer over rows that arrive in three slices, some of them late: lags, smoothing, neighbours, weekdays as on the table."""
    df = tables.readings_split(spark, SF)
    config = jobs.BuildConfig(lags=6)
    jobs.fit_scorer(df, tables.edges(spark, df), str(tmp_path / "s"), config=config, max_iter=3)
    scorer = jobs.load_scorer(spark, str(tmp_path / "s"))
    start = pd.Timestamp("2024-01-21")
    rows = df.filter("test_set").drop("test_set")
    number = (F.unix_seconds("date") - int(start.timestamp())) / 3600
    slices = rows.withColumn("slice", F.least(F.lit(2), F.floor((number + F.when(number % 7 == 0, 15).otherwise(0)) / 80)).cast("int"))
    path = str(tmp_path / "r")
    stream.run_scorer(slices, scorer, path)
    kept, top = in_time(slices)
    assert len(kept) == rows.count()  # all came in time
    expected = jobs.score_rows(rows, scorer).filter(F.col("input_time") <= F.lit(top) - F.expr("interval 1 day"))
    found = stream.scored(spark, path)
    assert expected.count() > 200
    assert plain(found) == plain(expected.select(*found.columns))


def series(n=700, sensors=3, seed=3):
    r = np.random.default_rng(seed)
    rows = []
    for s in range(sensors):
        x = 50 + np.cumsum(r.normal(0, 2, n))
        x[r.random(n) < 0.15] = np.nan
        x[: 4 * s] = np.nan
        rows += [(f"S{s}", (pd.Timestamp("2024-01-01") + pd.Timedelta(minutes=i)).to_pydatetime(), None if np.isnan(v) else float(v)) for i, v in enumerate(x)]
    return rows


@pytest.mark.parametrize("batch", [1, 7, 10_000])
def test_recurrences_do_not_depend_on_batches(spark, batch):
    """State carried from batch to batch: exponential means as pandas gives them for whole series, the smoother as a linear recursion."""
    rows = series(300 if batch == 1 else 700)
    df = spark.createDataFrame(rows, "sensor_id string, date timestamp, value double").repartition(5)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        means = kernels.ewmas(df, {"fast": 0.5, "slow": 0.1}).toPandas()
        stats = spark.createDataFrame([(f"S{s}", 50.0, 9.0 * s) for s in range(3)], "sensor_id string, mean double, var double")
        smooth = kernels.kalman(df, stats, "k", q=1.5).toPandas()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    for s in range(3):
        own = means[means.sensor_id == f"S{s}"].sort_values("date")
        for name, alpha in (("fast", 0.5), ("slow", 0.1)):
            assert np.allclose(own[name], own.value.ewm(alpha=alpha, adjust=False, ignore_na=False).mean(), equal_nan=True, rtol=1e-12)
        own = smooth[smooth.sensor_id == f"S{s}"].sort_values("date")
        y, m, p, var, q = own.value.ffill().bfill().to_numpy(), 50.0, 9.0 * s, 9.0 * s, 1.5
        states, covs = [], []
        for i, v in enumerate(y):
            ahead = p + q if i else p
            gain = ahead / (ahead + var) if ahead + var else 0.0
            m, p = m + gain * (v - m), ahead * (1 - gain)
            states.append(m)
            covs.append(p)
        for i in range(len(y) - 2, -1, -1):
            states[i] += covs[i] / (covs[i] + q) * (states[i + 1] - states[i])
        assert np.allclose(own.k, states, rtol=1e-9)
    assert list(means.columns) == ["sensor_id", "date", "value", "fast", "slow"]


def test_rank_correlation(spark):
    r = np.random.default_rng(1)
    pdf = pd.DataFrame({"sensor_id": "a", "date": pd.Timestamp("2024-01-01"), "value": r.integers(0, 40, 3000).astype(float)})
    pdf["x"], pdf["y"], pdf["z"] = np.exp(pdf.value + r.normal(0, 5, 3000)), -(pdf.value // 7), r.normal(0, 1, 3000)
    pdf.loc[::50, "x"] = np.nan
    df = spark.createDataFrame(pdf)
    df = df.withColumn("x", F.when(~F.isnan("x"), F.col("x")))
    found = {c.column: c.correlation for c in predict.correlation_select(df, ["x", "y", "z"], 0.0, "spearman").collect()}
    whole = pdf[["x", "y", "z", "value"]].dropna().rank().corr()["value"]
    assert found == pytest.approx({c: whole[c] for c in "xyz"}, abs=1e-9)
    assert predict.keep_correlated(df, ["x", "y", "z"], 0.5, "spearman").columns == ["sensor_id", "date", "value", "x", "y"]
    with pytest.raises(ValueError, match="kendall"):
        predict.correlation_select(df, ["x"], 0.1, "kendall")


def test_repeated_keys_need_an_order(spark):
    at = pd.Timestamp("2024-01-01").to_pydatetime()
    rows = [(at, at, "a", 1.0, 2.0, 3.0, 2), (at, at, "a", 9.0, None, 1.0, 1), (at, at, "b", 5.0, 6.0, 7.0, 1)]
    df = spark.createDataFrame(rows, "date timestamp, prediction_time timestamp, sensor_id string, y double, y_pred double, value double, seq int")
    last = predict.predictions_to_wide(df, ["a", "b"], order="seq").first()
    assert (last.a, last.a_pred, last.a_at_issued_time, last.b) == (1.0, 2.0, 3.0, 5.0)
    assert predict.predictions_to_wide(df, ["a", "b"], mean=True).first().a == 5.0
    with pytest.raises(ValueError, match="repeated"):
        predict.predictions_to_wide(df, ["a", "b"])
    assert predict.predictions_to_wide(df.filter("seq = 1"), ["a", "b"]).first().a == 9.0


def test_types_and_fields(spark):
    df = spark.createDataFrame([(1, 1 << 40, 300, 3.5, 12, True)], "sensor_uid long, event_id long, n long, prev_wd_mean double, hour long, is_new boolean")
    assert dict(shape.enforce_dtypes(df).dtypes) == {"sensor_uid": "int", "event_id": "bigint", "n": "smallint", "prev_wd_mean": "float", "hour": "tinyint", "is_new": "boolean"}
    assert len(io.RAW_FIELDS) == 29
    assert io.RAW_FIELDS.index("value") == 3


def test_training_tables_are_not_built_twice(spark, tmp_path):
    df = tables.readings_split(spark, SF)
    path = str(tmp_path / "t")
    assert not jobs._exists(spark, path)
    jobs.build_training_tables(df, tables.edges(spark, df), path, [1], jobs.BuildConfig(lags=2))
    assert jobs._exists(spark, f"{path}/tables/horizon=1")
    jobs.build_training_tables(df.filter("false"), tables.edges(spark, df), path, [1], jobs.BuildConfig(lags=2))
    assert spark.read.parquet(f"{path}/tables").count() > 0


def test_chunks_of_time_equal_the_whole_series(spark):
    """Windows by (sensor, chunk) with rows around each chunk give what windows by sensor give."""
    df = spark.createDataFrame(series(700), "sensor_id string, date timestamp, value double")
    for op in (lambda f, c: features.lag_features(f, 5, cols=c), lambda f, c: features.rolling_extrema(f, 10, cols=c), lambda f, c: features.rolling_slope(f, cols=c)):
        whole, chunked = op(df, base.COLS), base.in_chunks(df, op, hours=2, before=1)
        assert set(chunked.columns) == set(whole.columns)
        assert plain(chunked.select(*whole.columns)) == plain(whole)
    ahead = lambda f, c: f.withColumn("next", F.lead("value", 3).over(c.series()))
    assert plain(base.in_chunks(df, ahead, 3, 0, 1)) == plain(ahead(df, base.COLS))


def test_running_sums_equal_frames(spark):
    df = spark.createDataFrame(series(700), "sensor_id string, date timestamp, value double")
    long = features.rolling_context(df, (250,)).toPandas().sort_values(["sensor_id", "date"])
    short = features._against("value", base.COLS.trailing(250), 250)
    frames = df.withColumns(short).toPandas().sort_values(["sensor_id", "date"])
    for c in ("dev_250", "z_250", "ratio_250"):
        assert np.allclose(long[c].astype(float), frames[c].astype(float), equal_nan=True, atol=1e-8)


def test_residual_workflow_corrects_a_bias(spark):
    rows = [("S0", (pd.Timestamp("2024-01-01") + pd.Timedelta(hours=i)).to_pydatetime(), 50.0, 60.0 + i % 3, 55.0 + i % 3) for i in range(200)]
    df = spark.createDataFrame(rows, "sensor_id string, date timestamp, value double, y double, y_pred double")
    found = {r.variant: r.mae for r in jobs.residual_workflow(df, ["value"], max_iter=20, step_size=0.5).collect()}
    assert found["raw"] == pytest.approx(5.0)
    assert found["corrected"] < 1.0


def test_states_of_all_transformers_are_stored_together(spark, tmp_path):
    df = features.create_target(tables.readings_split(spark, SF), 1)
    edges, train, test = tables.edges(spark, df), df.filter("not test_set"), df.filter("test_set")
    states = jobs.fit_all_states(train, edges, minutes_per_row=60)
    jobs.save_states(states, str(tmp_path / "s"))
    again = jobs.load_states(spark, str(tmp_path / "s"))
    assert again.keys() == states.keys() == {"ordinal", "congestion", "outlier", "mean", "labels", "upstream"}
    out = jobs.apply_states(test, again)
    assert plain(out) == plain(jobs.apply_states(test, states))
    for c in ("sensor_uid", "sensor_mean", "is_congested", "is_outlier", "target_scaled", "up1_shift_speed"):
        assert c in out.columns
    shifted = {tuple(r) for r in out.select("sensor_id", "date", "up1_shift_speed").collect()}
    assert shifted == {tuple(r) for r in predict.concat_parts([jobs.graph.upstream_shifted(test, states["upstream"])]).select("sensor_id", "date", "up1_shift_speed").collect()}
    assert "target_scaled" not in jobs.apply_states(test.drop("target"), again).columns
    assert jobs.fit_states(train).keys() == {"ordinal", "congestion", "outlier"}
