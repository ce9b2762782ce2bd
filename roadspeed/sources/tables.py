"""Readings, road graph and predictions derived from the test tables, as Spark frames and as the same SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.base import COLS, minutes

#: Hourly rows.
STEP_MIN = 60
SENSORS = [f"S{i:02d}" for i in range(8)]


def _mean(cents: Column) -> Column:
    """The mean of whole cents to four decimals, rounded as in the SQL below: scaled first, so that a mean that lies on a tie goes the same way."""
    return F.round(F.sum(cents) / (F.lit(100.0) * F.count("*")) * F.lit(1e4)) / F.lit(1e4)


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet")


def readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly means of eight sensors, with gaps. Whole cents are summed, so the order of rows does not matter."""
    sensor = F.concat(F.lit("S"), F.lpad((F.col("user_id") % 8).cast("string"), 2, "0"))
    grid = events(spark, sf_dir).groupBy(sensor.alias("sensor_id"), F.date_trunc("hour", "ts").cast("timestamp").alias("date"))
    return grid.agg(_mean(F.round(F.col("value") * 100).cast("long")).alias("value"))


def readings_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every sensor and hour of the month; missing values are null."""
    hours = F.explode(F.expr("sequence(timestamp '2024-01-01 00:00:00', timestamp '2024-01-30 23:00:00', interval 1 hour)")).alias("date")
    grid = spark.range(8).select(F.format_string("S%02d", "id").alias("sensor_id"), hours)
    return grid.join(readings(spark, sf_dir), ["sensor_id", "date"], "left")


def readings_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Readings with a fixed test boundary."""
    return readings(spark, sf_dir).withColumn("test_set", F.col("date") >= F.lit("2024-01-21").cast("timestamp"))


def readings_irregular(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events(spark, sf_dir).select(F.col("user_id").cast("string").alias("sensor_id"), F.col("ts").cast("timestamp").alias("date"), "value", "event_id")


def readings_extreme(spark: SparkSession, sf_dir: str) -> DataFrame:
    hour = F.hour("date")
    return readings(spark, sf_dir).withColumn("value", F.when(hour == 5, F.col("value") * 3).when(hour == 17, 0.0).otherwise(F.col("value")))


def readings_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values as dirty text, and three weather columns."""
    k, text = F.col("event_id") % 50, F.format_string("%.2f", "value")
    dirty = F.when(k == 0, "n/a").when(k == 1, F.replace(text, F.lit("."), F.lit(" "))).when(k == 2, "1 000,5").when(k == 3, F.lit(None)).otherwise(text)
    weather = {n: (F.col("event_id") % m).cast("double") for n, m in (("temperature", 35), ("visibility", 100), ("precipitation", 7))}
    return readings_irregular(spark, sf_dir).withColumns({"value": dirty, "incremental_id": F.col("event_id")} | weather).drop("event_id")


def readings_large(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as sensors, days as time. Keys are grouped as numbers, which are shorter than their text."""
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    grid = rows.groupBy("l_suppkey", F.col("l_shipdate").cast("timestamp").alias("date")).agg(_mean(F.round(F.col("l_quantity") * 100).cast("long")).alias("value"))
    return grid.select(F.col("l_suppkey").cast("string").alias("sensor_id"), "date", "value")


def edges(spark: SparkSession, readings: DataFrame) -> DataFrame:
    """A corridor S00 .. S07 over the sensors that have readings: k-th neighbour i + k down and i - k up the road, none outside."""
    i = F.substring("sensor_id", 2, 2).cast("int")
    steps = F.explode(F.expr("array(named_struct('direction', 'down', 'k', 1), named_struct('direction', 'down', 'k', 2), named_struct('direction', 'down', 'k', 3), named_struct('direction', 'up', 'k', 1), named_struct('direction', 'up', 'k', 2), named_struct('direction', 'up', 'k', 3))")).alias("e")
    rows = readings.select("sensor_id").distinct().select("sensor_id", i.alias("i"), steps).select("sensor_id", "i", "e.*")
    j = F.col("i") + F.when(F.col("direction") == "down", F.col("k")).otherwise(-F.col("k"))
    inside = j.between(0, 7)
    return rows.select("sensor_id", "direction", "k", F.when(inside, F.format_string("S%02d", j)).alias("neighbor_id"), F.when(inside, (500 * F.col("k") + 25 * F.col("i")).cast("double")).alias("distance"))


def external_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = readings(spark, sf_dir).filter(F.hour("date") % 7 != 0)
    return rows.select("sensor_id", F.round(F.col("value") * 0.9 + 4, 6).alias("gman_prediction"), F.col("date").alias("gman_prediction_date"), (F.col("date") + minutes(60)).alias("gman_target_date"))


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """model, horizon, sensor_id, date, prediction_time, value, y, y_pred of two simple models at horizons of 1 and 3 rows."""
    w = COLS.series()
    base = readings(spark, sf_dir).withColumns({"_drift": F.coalesce(F.col("value") + F.lit(0.5) * (F.col("value") - F.lag("value").over(w)), "value")} | {f"_y{h}": F.lead("value", h).over(w) for h in (1, 3)})
    cells = F.explode(F.array(*[F.struct(F.lit(m).alias("model"), F.lit(h).alias("horizon"), F.col(f"_y{h}").alias("y"), F.col(p).alias("y_pred")) for h in (1, 3) for m, p in (("persist", "value"), ("drift", "_drift"))])).alias("c")
    return base.select("sensor_id", "date", "value", cells).select("sensor_id", "date", "value", "c.*").withColumn("prediction_time", F.col("date") + minutes(60 * F.col("horizon"))).filter("y is not null")


def step_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """sensor_id, date, timestep 1..3, y, y_pred."""
    w = COLS.series()
    ahead = readings(spark, sf_dir).withColumns({f"_y{k}": F.lead("value", k).over(w) for k in (1, 2, 3)})
    cells = F.explode(F.array(*[F.struct(F.lit(k).alias("timestep"), F.col(f"_y{k}").alias("y"), F.col("value").alias("y_pred")) for k in (1, 2, 3)])).alias("c")
    return ahead.select("sensor_id", "date", cells).select("sensor_id", "date", "c.*").filter("y is not null")


def wide_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """External predictions as a wide table: sample_nr, timestep 0..2, timestamp, and s, s_pred of each sensor."""
    full = readings_full(spark, sf_dir).groupBy("date").pivot("sensor_id", SENSORS).agg(F.first("value"))
    hour = F.floor((F.unix_seconds("date") - F.unix_seconds(F.lit("2024-01-01").cast("timestamp"))) / 3600)
    columns = [c for x in SENSORS for c in (F.col(x), (F.col(x) * 0.9).alias(f"{x}_pred"))]
    return full.select((hour / 3).cast("int").alias("sample_nr"), (hour % 3).cast("int").alias("timestep"), F.col("date").alias("timestamp"), *columns)


# The same frames for the SQL side.
READINGS = """readings AS (
    SELECT 'S' || lpad((user_id % 8)::varchar, 2, '0') AS sensor_id, date_trunc('hour', ts) AS date,
           round(sum(round(value * 100)::bigint) / (100.0 * count(*)), 4)::double AS value
    FROM events GROUP BY 1, 2)"""
READINGS_LARGE = """readings AS (
    SELECT l_suppkey::varchar AS sensor_id, l_shipdate::timestamp AS date, round(sum(round(l_quantity * 100)::bigint) / (100.0 * count(*)), 4)::double AS value
    FROM lineitem GROUP BY 1, 2)"""
FULL = READINGS + """, readings_full AS (
    SELECT s.sensor_id, g.date, r.value
    FROM (SELECT 'S' || lpad(i::varchar, 2, '0') AS sensor_id FROM range(8) t(i)) s
    CROSS JOIN (SELECT unnest(generate_series(TIMESTAMP '2024-01-01', TIMESTAMP '2024-01-30 23:00:00', INTERVAL 1 HOUR)) AS date) g
    LEFT JOIN readings r ON r.sensor_id = s.sensor_id AND r.date = g.date)"""
SPLIT = READINGS + ", split AS (SELECT *, date >= TIMESTAMP '2024-01-21' AS test_set FROM readings)"
IRREGULAR = "irregular AS (SELECT user_id::varchar AS sensor_id, ts AS date, value, event_id FROM events)"
EXTREME = READINGS + ", extreme AS (SELECT sensor_id, date, CASE hour(date) WHEN 5 THEN value * 3 WHEN 17 THEN 0.0 ELSE value END AS value FROM readings)"
RAW = """raw AS (
    SELECT user_id::varchar AS sensor_id, ts AS date, event_id,
           CASE event_id % 50 WHEN 0 THEN 'n/a' WHEN 1 THEN replace(printf('%.2f', value), '.', ' ') WHEN 2 THEN '1 000,5' WHEN 3 THEN NULL ELSE printf('%.2f', value) END AS value
    FROM events)"""
EDGES = READINGS + """, e0 AS (
    SELECT sensor_id, sensor_id[2:3]::int AS i, direction, k, sensor_id[2:3]::int + CASE WHEN direction = 'down' THEN k ELSE -k END AS j
    FROM (SELECT DISTINCT sensor_id FROM readings) CROSS JOIN (VALUES ('down'), ('up')) d(direction) CROSS JOIN (VALUES (1), (2), (3)) n(k)
), edges AS (
    SELECT sensor_id, direction, k, CASE WHEN j BETWEEN 0 AND 7 THEN 'S' || lpad(j::varchar, 2, '0') END AS neighbor_id,
           CASE WHEN j BETWEEN 0 AND 7 THEN (500 * k + 25 * i)::double END AS distance
    FROM e0)"""
EXTERNAL = READINGS + """, external AS (
    SELECT sensor_id, round(value * 0.9 + 4, 6) AS gman_prediction, date AS gman_prediction_date, date + INTERVAL 1 HOUR AS gman_target_date
    FROM readings WHERE hour(date) % 7 <> 0)"""
PREDICTIONS = READINGS + """, p0 AS (
    SELECT *, coalesce(value + 0.5 * (value - lag(value) OVER w), value) AS drift, lead(value, 1) OVER w AS y1, lead(value, 3) OVER w AS y3
    FROM readings WINDOW w AS (PARTITION BY sensor_id ORDER BY date)
), predictions AS (
    SELECT m.model, h.horizon, sensor_id, date, value, CASE h.horizon WHEN 1 THEN y1 ELSE y3 END AS y,
           CASE m.model WHEN 'persist' THEN value ELSE drift END AS y_pred, date + to_hours(h.horizon) AS prediction_time
    FROM p0 CROSS JOIN (VALUES ('persist'), ('drift')) m(model) CROSS JOIN (VALUES (1), (3)) h(horizon)
    WHERE CASE h.horizon WHEN 1 THEN y1 ELSE y3 END IS NOT NULL)"""
STEPS = READINGS + """, s0 AS (
    SELECT sensor_id, date, k AS timestep, value AS y_pred,
           CASE k WHEN 1 THEN lead(value, 1) OVER w WHEN 2 THEN lead(value, 2) OVER w ELSE lead(value, 3) OVER w END AS y
    FROM readings CROSS JOIN (VALUES (1), (2), (3)) n(k) WINDOW w AS (PARTITION BY sensor_id, k ORDER BY date)
), steps AS (SELECT * FROM s0 WHERE y IS NOT NULL)"""
WIDE = FULL + f""", wide AS (
    SELECT (epoch(date - TIMESTAMP '2024-01-01') / 3600)::bigint // 3 AS sample_nr, (epoch(date - TIMESTAMP '2024-01-01') / 3600)::bigint % 3 AS timestep, date AS timestamp,
           {", ".join(f"max(value) FILTER (sensor_id = '{x}') AS {x}, max(value) FILTER (sensor_id = '{x}') * 0.9 AS {x}_pred" for x in SENSORS)}
    FROM readings_full GROUP BY date)"""
