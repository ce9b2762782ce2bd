"""Shown doubles are rounded half away from zero, as ``round`` does, without a decimal for each value."""

import random

import pytest
from pyspark.sql import functions as F

from roadspeed import queries as road


@pytest.mark.parametrize("digits", [0, 3, 6])
def test_equals_round(spark, monkeypatch, digits):
    r = random.Random(4)
    values = [None, 0.0, -0.0, 0.5, -0.5, 1.5, 2.5, -2.5, 0.49999999999999994, -1e-9, 1e-9, float("nan"), float("inf"), float("-inf"), 2.0**51 + 0.5, 2.0**52 + 1, -1e300]
    values += [r.uniform(-1, 1) * 10.0 ** r.randint(-8, 12) for _ in range(3000)] + [r.randint(-(10**7), 10**7) / 2 / 10**digits for _ in range(1000)]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    for off in (0.0, road._OFF_TIES):
        monkeypatch.setattr(road, "_OFF_TIES", off)
        plain = F.round(F.col("v") * F.lit(10.0**digits) + F.lit(off)) / F.lit(10.0**digits)
        rows = df.select("v", plain.alias("a"), road._rounded(F.col("v"), digits).alias("b")).collect()
        assert [x.v for x in rows if str(x.a) != str(x.b)] == []


def test_no_decimals_in_the_plan(spark):
    plan = spark.range(1).select(road._rounded(F.col("id") / 7, 6))._jdf.queryExecution().optimizedPlan().toString()
    assert "rint" in plan.lower() and "round(" not in plan.lower()
