"""Exact quantiles by rank: those of ``percentile`` over values with ties, gaps and groups, at every step of narrowing."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from roadspeed.functions import quantiles
from roadspeed.operators import predict

PS = {"a": 0.0, "b": 0.01, "c": 0.5, "d": 0.9, "e": 1.0}


def expected(df, by):
    return sorted(map(str, df.groupBy(*by).agg(*[F.percentile("v", p).alias(n) for n, p in PS.items()]).collect()))


@pytest.mark.parametrize("steps", [1024, 16])
def test_same_as_percentile(spark, monkeypatch, steps):
    monkeypatch.setattr(quantiles, "STEPS", steps)  # with few steps small tables are narrowed as well
    rng = np.random.default_rng(steps)
    kinds = {"ties": rng.integers(0, 7, 5000).astype(float), "one": np.full(3000, 4.5), "normal": rng.normal(0, 1, 9000), "skew": np.exp(rng.normal(0, 4, 4000)), "few": np.array([3.0, 1.0, 2.0]), "single": np.array([9.0])}
    rows = [(k, float(v)) for k, x in kinds.items() for v in x] + [(None, 1.0), (None, 2.0), ("ties", None), ("nothing", None)]
    df = spark.createDataFrame(rows, "g string, v double").repartition(5).persist()
    found = quantiles.exact_quantiles(df, "v", PS, ["g"])
    assert sorted(map(str, found.collect())) == [r for r in expected(df, ["g"]) if "nothing" not in r]
    assert sorted(map(str, quantiles.exact_quantiles(df, "v", PS).collect())) == expected(df, [])
    df.unpersist()


def test_only_the_bracket_is_put_in_order(spark, monkeypatch):
    df = spark.range(200_000).select((F.hash("id") * 1.0).alias("v"))
    found = quantiles.exact_quantiles(df, "v", {"m": 0.5})
    assert found.first().m == df.agg(F.percentile("v", 0.5)).first()[0]
    state = quantiles._round(df.select(F.col("v").alias("_v")), [], [0.5], [F.lit(True)], [F.lit(False)], []).withColumns({"_lo0": F.lit(None).cast("double"), "_hi0": F.lit(None).cast("double")})
    ends = quantiles._bracketed(state, [0.5]).first()
    assert 0 < df.filter(F.col("v").between(ends["_lo0"], ends["_hi0"])).count() < 1000
    assert "percentile(" not in found._jdf.queryExecution().executedPlan().toString()


def test_nothing_to_rank(spark):
    empty = spark.createDataFrame([(None,)], "v double")
    assert quantiles.exact_quantiles(empty, "v", {"m": 0.5}).collect()[0].m is None
    assert quantiles.exact_quantiles(empty.withColumn("g", F.lit(1)), "v", {"m": 0.5}, ["g"]).collect() == []
    metrics = predict.evaluate_model(spark.createDataFrame([], "y double, y_pred double")).collect()
    assert len(metrics) == 1 and metrics[0].n == 0 and metrics[0].median_ae is None


def test_metrics_by_group_with_a_missing_name(spark):
    rows = [("x", 1.0, 2.0), ("x", 1.0, 4.0), (None, 0.0, 5.0), ("x", float("nan"), 1.0), ("y", None, 1.0)]
    df = spark.createDataFrame(rows, "model string, y double, y_pred double")
    found = {r.model: (r.n, r.median_ae) for r in predict.evaluate_model(df, ["model"]).collect()}
    assert found == {"x": (2, 2.0), None: (1, 5.0)}
    assert predict.evaluate_model(df, ["model"], accuracy=100).count() == 2
