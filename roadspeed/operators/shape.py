"""Column selection and types by rule."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_LAG = re.compile(r"(?:relative_)?diff_lag(\d+)$")
_NEIGHBOR = re.compile(r"(?:down|up)stream_sensor_(?:congested_)?(\d+)$")
# Types of feature columns by name.
_FLOAT = re.compile(r"(?:value|longitude|latitude|gman_prediction|lag\d+|relative_diff_lag\d+|downstream_sensor_\d+|upstream_sensor_\d+)$|prev_wd_|weather_")
_TINY = ("hour", "day", "is_saturday", "is_sunday", "is_congested", "is_outlier")
_INT = ("sensor_uid",)
_WHOLE = ("tinyint", "smallint", "int", "bigint")
_BITS = (("tinyint", 7), ("smallint", 15), ("int", 31), ("bigint", 63))


def limit_columns(df: DataFrame, lags: int, neighbors: int) -> DataFrame:
    """Lag columns up to ``lags`` and neighbour columns up to ``neighbors``; all others stay."""

    def kept(name: str) -> bool:
        lag, nb = _LAG.match(name), _NEIGHBOR.match(name)
        return not (lag and int(lag[1]) > lags or nb and int(nb[1]) > neighbors)

    return df.select(*[c for c in df.columns if kept(c)])


def _smallest(df: DataFrame, names: list[str]) -> dict[str, str]:
    """The smallest type that holds the values of integer columns (one pass over the table)."""
    if not names:
        return {}
    ends = df.agg(*[f(f"`{c}`").alias(f"{k}_{c}") for c in names for k, f in (("lo", F.min), ("hi", F.max))]).first()
    fits = lambda c, bits: -(1 << bits) <= (ends[f"lo_{c}"] or 0) and (ends[f"hi_{c}"] or 0) < 1 << bits
    return {c: next(t for t, bits in _BITS if fits(c, bits)) for c in names}


def dtype_rules(df: DataFrame) -> dict[str, str]:
    """Type by column name for the columns that are listed; of the others, doubles become floats and integers the smallest type that holds them."""
    out, rest = {}, []
    for name, kind in df.dtypes:
        if kind.startswith("timestamp") or kind == "date":
            continue
        if name in _TINY:
            out[name] = "tinyint"
        elif name in _INT:
            out[name] = "int"
        elif _FLOAT.match(name) or kind in ("float", "double") or kind.startswith("decimal"):
            out[name] = "float"
        elif kind in _WHOLE:
            rest.append(name)
    return out | _smallest(df, rest)


def enforce_dtypes(df: DataFrame, rules: dict[str, str] | None = None) -> DataFrame:
    rules = rules or dtype_rules(df)
    return df.select(*[F.col(f"`{c}`").cast(rules[c]).alias(c) if c in rules else F.col(f"`{c}`") for c in df.columns])


def optimize_dtypes(df: DataFrame) -> DataFrame:
    """Integer columns in the smallest type that holds their values (one pass over the table), doubles as floats."""
    kinds = {c: "float" for c, t in df.dtypes if t == "double"}
    return enforce_dtypes(df, kinds | _smallest(df, [c for c, t in df.dtypes if t in _WHOLE[1:]]))


def dtype_table(df: DataFrame) -> DataFrame:
    """name, kind of every column."""
    return df.sparkSession.createDataFrame(df.dtypes, "name string, kind string")


def align_to_features(df: DataFrame, names: list[str]) -> DataFrame:
    """The listed columns in order; missing ones, and those without any value, are 0."""
    full = df.select(*[F.col(c) if c in df.columns else F.lit(None).cast("double").alias(c) for c in names])
    counts = full.agg(*[F.count(c).alias(c) for c in names]).first()
    return full.fillna(0, [c for c in names if not counts[c]])


def stacked(train: DataFrame, test: DataFrame) -> DataFrame:
    return train.withColumn("part", F.lit("train")).unionByName(test.withColumn("part", F.lit("test")))


def step_arrays(steps: DataFrame) -> DataFrame:
    """sensor_id, date, arrays y and y_pred over the steps of samples that have three."""
    rows = steps.groupBy("sensor_id", "date").agg(F.array_sort(F.collect_list(F.struct("timestep", "y", "y_pred"))).alias("s")).filter(F.size("s") == 3)
    return rows.select("sensor_id", "date", F.transform("s", lambda x: x["y"]).alias("y"), F.transform("s", lambda x: x["y_pred"]).alias("y_pred"))


def renamed(df: DataFrame, rule: Callable[[str], str]) -> DataFrame:
    return df.toDF(*map(rule, df.columns))


def rounded(df: DataFrame, decimals: int) -> DataFrame:
    """Float measures rounded."""
    return df.withColumns({c: F.round(c, decimals) for c, t in df.dtypes if t in ("float", "double")})
