"""Corrections with a recurrence, tree models and the grid search, against independent results."""

from datetime import datetime, timedelta

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.ml import PipelineModel
from pyspark.sql import functions as F

from roadspeed.operators import predict, split
from roadspeed.plans import jobs, trees

START = datetime(2024, 1, 1)


def series(spark, seed, n=40):
    rng = np.random.default_rng(seed)
    rows = [(s, START + timedelta(hours=i), float(v), float(p)) for s in "AB" for i, (v, p) in enumerate(zip(rng.uniform(20, 90, n), rng.uniform(5, 120, n), strict=True))]
    return spark.createDataFrame(rows, "sensor_id string, date timestamp, value double, y_pred double"), pd.DataFrame(rows, columns=["sensor_id", "date", "value", "y_pred"])


def corrected(df):
    return df.orderBy("sensor_id", "date").toPandas()


def posterior_mean(y, mean, var, q):
    """Mean of the states given all readings: the prior of the walk and the readings as one linear system."""
    n = len(y)
    precision, right = np.zeros((n, n)), np.asarray(y, float) / var
    precision[0, 0] += 1 / var
    right[0] += mean / var
    for i in range(1, n):
        precision[i - 1 : i + 1, i - 1 : i + 1] += np.array([[1, -1], [-1, 1]]) / q
    return np.linalg.solve(precision + np.eye(n) / var, right)


def test_kalman_is_the_posterior_mean(spark):
    df, pdf = series(spark, 1)
    df = df.withColumn("y_pred", F.when(F.hour("date") != 5, F.col("y_pred")))
    pdf.loc[pdf.date.dt.hour == 5, "y_pred"] = np.nan
    stats = spark.createDataFrame([("A", 50.0, 100.0), ("B", 60.0, 9.0)], "sensor_id string, mean double, var double")
    out = corrected(predict.correct_kalman(df, stats, q=4.0))
    for sensor, mean, var in (("A", 50.0, 100.0), ("B", 60.0, 9.0)):
        y = pdf[pdf.sensor_id == sensor].y_pred.ffill().bfill()
        assert out[out.sensor_id == sensor].y_pred.tolist() == pytest.approx(posterior_mean(y, mean, var, 4.0).tolist(), abs=0.0051)


def test_all_corrections_in_order(spark):
    df, pdf = series(spark, 2)
    stats = spark.createDataFrame([("A", 40.0, 70.0), ("B", 45.0, 80.0)], "sensor_id string, min double, max double")
    out = corrected(predict.correct_all(df, stats))
    for sensor, low, high in (("A", 40, 70), ("B", 45, 80)):
        own = pdf[pdf.sensor_id == sensor]
        p = own.y_pred.where(((own.y_pred - own.value) / own.value).abs() <= 0.5, own.value).round(2)
        p = p.rolling(3, min_periods=1).median().round(2).ewm(span=3, adjust=False).mean().round(2).clip(low, high)
        assert out[out.sensor_id == sensor].y_pred.tolist() == pytest.approx(p.tolist(), abs=0.0101)


def steps(spark, n=240):
    """A target that is a step of one feature; every tenth row lacks the other one."""
    rows = [("AB"[i % 2], START + timedelta(hours=i // 2), float(40 + i % 7), None if i % 10 == 0 else float(i % 5), -6.0 if i % 7 < 3 else 9.0) for i in range(n)]
    return spark.createDataFrame(rows, "sensor_id string, date timestamp, value double, x double, target double")


def test_tree_model_and_scores(spark, tmp_path):
    df, names = steps(spark), ["value", "x"]
    assert jobs.feature_names(df) == names
    model = jobs.fit_tree_model(df, names, max_depth=2, step_size=0.5, max_iter=8)
    out = corrected(jobs.batch_score(model, df, names))
    assert len(out) == 240
    assert np.abs(out.prediction - out.target).max() <= 0.5  # the gradient of the absolute loss is a sign, so trees move by the step even when exact
    assert out.y_pred_total.tolist() == pytest.approx((out.prediction + out.value).tolist())
    model.save(f"{tmp_path}/model")
    again = corrected(jobs.batch_score(PipelineModel.load(f"{tmp_path}/model"), df, names))
    assert again.prediction.tolist() == out.prediction.tolist()


def test_grid_search_over_expanding_folds(spark):
    df, names, grid = steps(spark), ["value", "x"], ((1, 0.01, 1), (2, 0.5, 4))
    table, best = jobs.grid_search_ts(df, names, grid, k=2)
    rows = {(r.max_depth, r.step_size, r.max_iter): r for r in table.collect()}
    assert set(rows) == set(grid)
    folds = split.ts_folds(df, 2).toPandas()
    for depth, step, n in grid:
        errors = []
        for k in (1, 2):
            ends = folds[folds.fold == k].date.agg(["min", "max"])
            model = jobs.fit_tree_model(df.filter(F.col("date") < F.lit(ends["min"])), names, "target", depth, step, n)
            test = jobs.batch_score(model, df.filter(F.col("date").between(ends["min"], ends["max"])), names).toPandas()
            errors.append(np.abs(test.prediction - test.target).mean())
        assert rows[depth, step, n].mae == pytest.approx(np.mean(errors), rel=1e-6)
    assert [r.best for r in rows.values()].count(True) == 1
    assert min(rows.values(), key=lambda r: r.mae).best
    assert np.abs((p := jobs.batch_score(best, df, names).toPandas()).prediction - p.target).mean() < 3


def test_compiled_trees_score_as_the_model(spark):
    """The expression and the SQL of a fitted model give what its own transform gives."""
    rng = np.random.default_rng(7)
    pdf = pd.DataFrame({"a": rng.normal(0, 1, 3000), "b c": rng.integers(0, 9, 3000), "target": 0.0})
    pdf["target"] = np.where(pdf.a > 0.3, pdf["b c"], -3.0) + rng.normal(0, 0.1, 3000)
    df, names = spark.createDataFrame(pdf), ["a", "b c"]
    for loss in ("squared", "absolute"):
        model = jobs.fit_tree_model(df, names, max_depth=4, max_iter=6, loss=loss)
        parsed = trees.trees_of(model)
        assert len(parsed) == 6
        out = model.transform(df).withColumn("own", trees.expression(model)).agg(F.max(F.abs(F.col("own") - F.col("prediction")))).first()[0]
        assert out < 1e-9
        con = duckdb.connect()
        con.register("rows", pdf)
        theirs = con.sql(f"SELECT {trees.to_sql(parsed, chr(34))} AS p FROM rows").fetchnumpy()["p"]
        assert np.allclose(np.sort(theirs), np.sort(model.transform(df).toPandas().prediction), atol=1e-9)


def test_large_models_keep_their_own_transform(spark, monkeypatch):
    df, names = steps(spark), ["value", "x"]
    model = jobs.fit_tree_model(df, names, max_depth=2, max_iter=3)
    expected = corrected(jobs.batch_score(model, df, names))
    assert "CASE WHEN" in jobs.batch_score(model, df, names)._jdf.queryExecution().executedPlan().toString()
    monkeypatch.setattr(trees, "MAX_NODES", 3)
    out = jobs.batch_score(model, df, names)
    assert "CASE WHEN" not in out._jdf.queryExecution().executedPlan().toString()
    assert np.allclose(corrected(out).prediction, expected.prediction)
    assert out.columns == jobs.batch_score(model, df, names).columns


def test_text_form_of_trees():
    text = "DecisionTreeRegressionModel: depth=1\n  If (feature 1 <= 1.0E-4)\n   Predict: -2.5E10\n  Else (feature 1 > 1.0E-4)\n   Predict: 3.0"
    assert trees.parse_trees(text, ["x", "y"]) == [(1.0, trees.Split("y", 1e-4, -2.5e10, 3.0))]
    assert trees.parse_trees("", []) == [] and trees.to_sql([]) == "CAST(0 AS DOUBLE)"
    with pytest.raises(ValueError, match="numeric"):
        trees.parse_trees("If (feature 0 <= 1.0)\nPredict: 1.0\nElse (feature 0 > 2.0)\nPredict: 2.0", ["x"])


def test_stages_of_one_fit_are_the_fits_with_fewer_trees(spark):
    df, names = steps(spark).withColumn("target", F.col("value") * F.col("target")), ["value", "x"]
    most = jobs.fit_tree_model(df, names, max_depth=3, max_iter=6)
    errors = jobs.staged_errors(most, df, names)
    assert len(errors) == 6
    for n in (1, 3, 6):
        out = jobs.batch_score(jobs.fit_tree_model(df, names, max_depth=3, max_iter=n), df, names).toPandas()
        assert errors[n - 1] == pytest.approx(np.abs(out.prediction - out.target).mean(), rel=1e-9)
    assert len(jobs.QUERY_GRID) == len(jobs.GRID) == 32
