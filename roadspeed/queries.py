"""One query for each operator over the test tables, with the same result in SQL where SQL can express it.

The column list of a query names the kind of each column: ``@t`` timestamp (shown as text), ``@d`` double (six decimals),
``@f`` double (three decimals, for spreads of large numbers), ``@i`` integer, none: as it is. Both sides are cast by it, so their types and roundings agree.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import clean as C
from .operators import features as X
from .operators import graph as G
from .operators import predict as P
from .operators import shape as H
from .operators import split as S
from .operators.base import in_chunks
from .plans import jobs as J
from .plans import trees as TR
from .sources import io as IO
from .sources import tables as T
from .streaming import stream as ST

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
SPECS: dict[str, str] = {}

_KEYS = "sensor_id date@t "
_W = " WINDOW w AS (PARTITION BY sensor_id ORDER BY date)"
#: Added before rounding, in units of the last digit, on both sides: means of short decimals often lie just on a tie, where the last bit of a sum, which depends on the order of rows, would decide.
_OFF_TIES = 0.0123456789
#: Doubles that are rounded column by column. More are one array: the generated method of so many roundings is too long for the JVM to compile, and is interpreted.
_MANY = 8


def _rounded(c: Column, digits: int) -> Column:
    """Half away from zero, as in the SQL, in arithmetic of doubles: ``round`` makes a decimal of each value. Adding zero takes the sign off a zero."""
    x = c.cast("double") * F.lit(10.0**digits) + F.lit(_OFF_TIES)
    whole = F.rint(x)
    return F.when(F.abs(x - whole) == 0.5, x + F.signum(x) * 0.5).otherwise(whole) / F.lit(10.0**digits) + F.lit(0.0)


def _shown(df: DataFrame, spec: str) -> DataFrame:
    names = [x.partition("@")[::2] for x in spec.split()]
    doubles = {n: i for i, n in enumerate(n for n, kind in names if kind == "d")}
    many = len(doubles) > _MANY
    if many:
        df = df.withColumn("_doubles", F.transform(F.array(*[F.col(f"`{n}`").cast("double") for n in doubles]), lambda x: _rounded(x, 6)))
    out = []
    for name, kind in names:
        c = F.col(f"`{name}`")
        d = lambda c=c, name=name: F.get("_doubles", F.lit(doubles[name])) if many else _rounded(c, 6)
        c = {"t": lambda c=c: F.date_format(c, "yyyy-MM-dd HH:mm:ss"), "d": d, "f": lambda c=c: _rounded(c, 3), "i": lambda c=c: c.cast("long"), "": lambda c=c: c}[kind]()
        out.append(c.alias(name))
    return df.select(*out)


def _select(spec: str) -> str:
    kinds = {"t": "strftime({0}, '%Y-%m-%d %H:%M:%S')", "d": f"round({{0}}::double * 1e6 + {_OFF_TIES}) / 1e6 + 0.0", "f": f"round({{0}}::double * 1e3 + {_OFF_TIES}) / 1e3 + 0.0", "i": "{0}::bigint", "": "{0}"}
    return ", ".join(f"{kinds[k].format(chr(34) + n + chr(34))} AS \"{n}\"" for n, _, k in (x.partition("@") for x in spec.split()))


def add(name: str, spec: str, fn: Callable[[SparkSession, str], DataFrame], ctes: str | None = None, body: str = "") -> None:
    """Register a query; ``body`` is the SQL of its rows, after the common table expressions."""
    SPECS[name] = spec
    QUERIES[name] = lambda spark, sf_dir: _shown(fn(spark, sf_dir), spec)
    if ctes is not None:
        ORACLE_SQL[name] = f"WITH {ctes}, result AS ({body}) SELECT {_select(spec)} FROM result"


def scratch(spark: SparkSession, name: str) -> str:
    return f"{J.shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


# 2.1 Sources and sinks
def _read_readings(spark: SparkSession, d: str) -> DataFrame:
    T.readings_split(spark, d).write.parquet(path := scratch(spark, "readings"))
    return IO.read_readings(spark, path, ["sensor_id", "date", "value"])


def _read_csv(spark: SparkSession, d: str) -> DataFrame:
    raw = T.readings_raw(spark, d).select("incremental_id", "date", "sensor_id", "value", "temperature")
    raw.write.csv(path := scratch(spark, "csv"))
    return IO.read_readings_csv(spark, path, ("incremental_id", "date", "sensor_id", "value", "temperature"))


def _read_default_csv(spark: SparkSession, d: str) -> DataFrame:
    """A file of all raw columns, read by the names that a file has by default."""
    weather = {n: (F.col("incremental_id") % (k + 2)).cast("double") for k, n in enumerate(IO.RAW_FIELDS[6:])}
    raw = T.readings_raw(spark, d).withColumns({"longitude": F.lit(23.5), "latitude": F.lit(37.25)} | weather).select(*[f"`{n}`" for n in IO.RAW_FIELDS])
    raw.write.csv(path := scratch(spark, "csv"))
    found = IO.read_readings_csv(spark, path)
    return found.withColumnsRenamed({"Ice_cover_surface": "ice", "v-component_of_wind_height_above_ground": "wind"})


def _write_records(spark: SparkSession, d: str) -> DataFrame:
    """The file that the sink wrote, read back."""
    IO.write_records_json(T.readings(spark, d).withColumn("value", F.round("value", 1)), path := scratch(spark, "records"), 30_000)
    return spark.read.text(path)


def _typed(spark: SparkSession, d: str) -> DataFrame:
    """Feature columns in their types, with the types as text; ``code`` does not fit a float."""
    rows = X.calendar_features(T.readings(spark, d)).withColumns({"code": F.unix_seconds("date") * 7, "small": F.hour("date") * 5, "lag1": F.col("value")})
    typed = H.enforce_dtypes(rows)
    kinds = ",".join(f"{c}:{t}" for c, t in typed.dtypes if c in ("value", "hour", "day", "is_saturday", "code", "small", "lag1"))
    return typed.withColumns({"kinds": F.lit(kinds), "value": F.round("value", 2)})


def _repeated(spark: SparkSession, d: str) -> DataFrame:
    """Predictions of which some came twice; the later row lacks its value."""
    again = _drift(spark, d).filter("hour(date) % 3 = 0").withColumns({"y_pred": F.col("y_pred") - 5, "value": F.lit(None).cast("double"), "seq": F.lit(2)})
    return again.unionByName(_drift(spark, d).withColumn("seq", F.lit(1)))


def _read_graph(spark: SparkSession, d: str) -> DataFrame:
    edges, path = T.edges(spark, T.readings(spark, d)), scratch(spark, "graph")
    for x in ("down", "up"):
        IO.road_graph_json(edges, x).write.text(f"{path}/{x}")
    return IO.read_road_graph(spark, f"{path}/down", f"{path}/up")


def _read_records(spark: SparkSession, d: str) -> DataFrame:
    rows = T.readings(spark, d).withColumn("date", F.date_format("date", "yyyy-MM-dd'T'HH:mm:ss'Z'"))
    payload = rows.groupBy("sensor_id", F.substring("date", 1, 10)).agg(F.collect_list(F.struct("date", "sensor_id", "value")).alias("records"))
    return IO.read_records_json(payload.select(F.to_json(F.struct("records")).alias("value")))


def _compact(spark: SparkSession, d: str) -> DataFrame:
    IO.write_compact_parquet(T.readings_irregular(spark, d), path := scratch(spark, "compact"), drop=("event_id",), decimals=1, precision="minute", partition_by=("sensor_id",))
    return spark.read.parquet(path).withColumn("sensor_id", F.col("sensor_id").cast("string")).groupBy("sensor_id", "date").agg(F.count("*").alias("n"), F.round(F.sum(F.round("value", 1).cast("decimal(18,1)")), 1).alias("total"))


def _load_external(spark: SparkSession, d: str) -> DataFrame:
    folder = scratch(spark, "saved")
    T.external_predictions(spark, d).write.parquet(f"{folder}/P12_Q12_run")
    T.external_predictions(spark, d).limit(1).write.parquet(f"{folder}/P3_Q3_run")
    return IO.load_external_predictions(spark, folder, 12, 12)


add("read_readings", _KEYS + "value@d", _read_readings, T.READINGS, "SELECT * FROM readings")
add("read_readings_csv", "incremental_id@i sensor_id value", _read_csv, T.RAW, "SELECT event_id AS incremental_id, sensor_id, value FROM raw")
add(
    "read_readings_csv_default", "incremental_id@i date@t sensor_id value longitude@d latitude@d ice@d wind@d", _read_default_csv, T.RAW,
    "SELECT event_id AS incremental_id, date_trunc('millisecond', date) AS date, sensor_id, value, 23.5 AS longitude, 37.25 AS latitude, event_id % 17 AS ice, event_id % 24 AS wind FROM raw",
)
add("read_road_graph", "sensor_id direction k@i neighbor_id distance@d", _read_graph, T.EDGES, "SELECT * FROM edges")
add("read_records_json", _KEYS + "value@d", _read_records, T.READINGS, "SELECT * FROM readings")
add(
    "write_records_json", "value", _write_records, T.READINGS,
    "SELECT '{\"date\":\"' || strftime(date, '%Y-%m-%dT%H:%M:%SZ') || '\",\"sensor_id\":\"' || sensor_id || '\",\"value\":' || round(value, 1)::varchar || '}' AS value FROM (SELECT * FROM readings ORDER BY date, sensor_id LIMIT 30000)",
)
add("write_compact_parquet", _KEYS + "n@i total@d", _compact, T.IRREGULAR, "SELECT sensor_id, date_trunc('minute', date) AS date, count(*) AS n, sum(round(value, 1)) AS total FROM irregular GROUP BY 1, 2")
add("load_external_predictions", "sensor_id gman_prediction@d gman_prediction_date@t gman_target_date@t", _load_external, T.EXTERNAL, "SELECT * FROM external")

# 2.2 Projections, casts, filters
add("clean_value", "event_id@i value@d", lambda s, d: T.readings_raw(s, d).select(F.col("incremental_id").alias("event_id"), C.clean_value(F.col("value")).alias("value")), T.RAW, "SELECT event_id, round(try_cast(replace(value, ' ', '.') AS double), 2) AS value FROM raw")
add("drop_misformatted", "incremental_id@i value@d", lambda s, d: C.drop_misformatted(T.readings_raw(s, d)), T.RAW, "SELECT event_id AS incremental_id, try_cast(value AS double) AS value FROM raw WHERE try_cast(value AS double) IS NOT NULL AND NOT contains(value, ' ')")
add(
    "align_timeframe", _KEYS + "value@d event_id@i", lambda s, d: C.align_timeframe(T.readings_irregular(s, d)), T.IRREGULAR,
    "SELECT i.* FROM irregular i, (SELECT min(date) lo, max(date) hi FROM irregular GROUP BY sensor_id ORDER BY count(*), sensor_id LIMIT 1) WHERE date BETWEEN lo AND hi",
)
add(
    "filter_uncommon_counts", "sensor_id event_id@i", lambda s, d: C.filter_uncommon_counts(T.readings_irregular(s, d)),
    T.IRREGULAR + ", c AS (SELECT sensor_id, count(*) n FROM irregular GROUP BY 1), m AS (SELECT n FROM c GROUP BY n ORDER BY count(*) DESC, n LIMIT 1)",
    "SELECT * FROM irregular WHERE sensor_id IN (SELECT sensor_id FROM c JOIN m USING (n))",
)
add("drop_weather", "incremental_id@i sensor_id", lambda s, d: C.drop_columns(T.readings_raw(s, d), ["temperature", "visibility", "precipitation", "altimeter"]).select("incremental_id", "sensor_id"), T.RAW, "SELECT event_id AS incremental_id, sensor_id FROM raw")
add(
    "limit_lag_adjacency_columns", _KEYS + "relative_diff_lag1@d relative_diff_lag2@d", lambda s, d: H.limit_columns(X.lag_features(T.readings(s, d), 4), lags=2, neighbors=0), T.READINGS,
    "SELECT sensor_id, date, coalesce((value - lag(value) OVER w) / (lag(value) OVER w + 1e-5), -1) AS relative_diff_lag1, coalesce((value - lag(value, 2) OVER w) / (lag(value, 2) OVER w + 1e-5), -1) AS relative_diff_lag2 FROM readings" + _W,
)
add(
    "enforce_dtypes", _KEYS + "value@d hour@i is_saturday@i code@i small@i kinds", _typed, T.READINGS,
    "SELECT sensor_id, date, round(value::float, 2) AS value, hour(date) AS hour, (isodow(date) = 6)::int AS is_saturday, epoch(date)::bigint * 7 AS code, hour(date) * 5 AS small, "
    "'value:float,hour:tinyint,day:tinyint,is_saturday:tinyint,code:bigint,small:tinyint,lag1:float' AS kinds FROM readings",
)
add("optimize_dtypes", "name kind", lambda s, d: H.dtype_table(H.optimize_dtypes(T.events(s, d).select("event_id", "user_id", (F.col("user_id") % 100).alias("small")))), "k AS (SELECT max(event_id) e, max(user_id) u, max(user_id % 100) s FROM events)", " UNION ALL ".join(f"SELECT '{n}' AS name, CASE WHEN {c} <= 127 THEN 'tinyint' WHEN {c} <= 32767 THEN 'smallint' WHEN {c} <= 2147483647 THEN 'int' ELSE 'bigint' END AS kind FROM k" for n, c in (("event_id", "e"), ("user_id", "u"), ("small", "s"))))
add("align_to_feature_list", "value@d hour@i nothing@d", lambda s, d: H.align_to_features(X.calendar_features(T.readings(s, d)), ["value", "hour", "nothing"]), T.READINGS, "SELECT value, hour(date) AS hour, 0 AS nothing FROM readings")
_ALL = " ".join(f"{x}@d" for x in T.SENSORS)
add("sanitize_wide", "date@t " + _ALL, lambda s, d: P.sanitize_wide(T.wide_predictions(s, d).withColumn("note", F.lit("x"))), T.WIDE, "SELECT timestamp AS date, * EXCLUDE (timestamp) FROM wide")
add("slice_test_raw", _KEYS + "value@d", lambda s, d: C.slice_test_raw(T.readings(s, d), F.lit("2024-01-21").cast("timestamp")), T.SPLIT, "SELECT * FROM split WHERE test_set")
add(
    "train_test_tables", "part value@d target@d", lambda s, d: H.stacked(*S.train_test_tables(X.create_target(T.readings_split(s, d), 1), ["prediction_time", "target_total_speed", "target_speed_delta"])), T.SPLIT,
    "SELECT CASE WHEN test_set THEN 'test' ELSE 'train' END AS part, value, target FROM (SELECT *, lead(value) OVER w - value AS target FROM split" + _W + ") WHERE target IS NOT NULL",
)

# 2.3 Train/test boundaries
_DATES = ", dates AS (SELECT date, row_number() OVER (ORDER BY date) - 1 AS idx, count(*) OVER () AS n FROM (SELECT DISTINCT date FROM readings))"
add("flag_test_set", _KEYS + "test_set", lambda s, d: S.flag_test_set(T.readings(s, d)), T.READINGS + _DATES, "SELECT sensor_id, date, date >= (SELECT min(date) FROM dates WHERE idx >= greatest(0, least(n - 1, floor(n * (1 - 1.0::double / 3))))) AS test_set FROM readings")
add(
    "flag_test_set_per_sensor", _KEYS + "test_set", lambda s, d: S.flag_test_set_per_sensor(T.readings(s, d)), T.READINGS,
    "SELECT sensor_id, date, i >= greatest(0, least(n - 1, floor(n * (1 - 1.0::double / 3)))) AS test_set FROM (SELECT *, row_number() OVER w - 1 AS i, count(*) OVER (PARTITION BY sensor_id) AS n FROM readings" + _W + ")",
)
_TARGET_SPLITS = ", tagged AS (SELECT date, max(test_set) AS f, row_number() OVER (ORDER BY date) - 1 AS idx FROM split GROUP BY date), edge AS (SELECT min(idx) FILTER (f) AS t FROM tagged), splits AS (SELECT date, idx, CASE WHEN idx >= t THEN 'test' WHEN idx >= t - floor(t * 0.3::double) THEN 'val' ELSE 'train' END AS split FROM tagged, edge)"
add("target_splits", "date@t idx@i split", lambda s, d: S.target_splits(T.readings_split(s, d)), T.SPLIT + _TARGET_SPLITS, "SELECT * FROM splits")
add("ratio_splits", "date@t idx@i split", lambda s, d: S.ratio_splits(T.readings(s, d)), T.READINGS + _DATES, "SELECT date, idx, CASE WHEN idx < round(n * 0.7::double) THEN 'train' WHEN idx < n - round(n * (1 - 0.7::double - 0.1::double)) THEN 'val' ELSE 'test' END AS split FROM dates")
_POS = ", placed AS (SELECT *, row_number() OVER (ORDER BY date, sensor_id) - 1 AS pos, count(*) OVER () AS n FROM readings)"
add("residual_split", _KEYS + "is_test", lambda s, d: S.residual_split(T.readings(s, d)), T.READINGS + _POS, "SELECT sensor_id, date, pos >= n - floor(n * 0.33::double) AS is_test FROM placed")
add("ts_folds", _KEYS + "fold@i", lambda s, d: S.ts_folds(T.readings(s, d)), T.READINGS + _POS, "SELECT sensor_id, date, greatest(0, 3 - (n - 1 - pos) // (n // 4)) AS fold FROM placed")

# 2.4 Cleaning on ordered series
_CHANGE = ", c0 AS (SELECT *, last_value(value IGNORE NULLS) OVER (PARTITION BY sensor_id ORDER BY date ROWS UNBOUNDED PRECEDING) AS now, last_value(value IGNORE NULLS) OVER (PARTITION BY sensor_id ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM extreme), c1 AS (SELECT sensor_id, date, value, coalesce(CASE WHEN before = 0 THEN now <> 0 ELSE abs((now - before) / before) > 0.7 END, false) AS x FROM c0)"
_FILL = """, f1 AS (SELECT *, row_number() OVER w AS r FROM f0 WINDOW w AS (PARTITION BY sensor_id ORDER BY date)), f2 AS (
    SELECT *, last_value(CASE WHEN value IS NOT NULL THEN r END IGNORE NULLS) OVER up AS pr, last_value(value IGNORE NULLS) OVER up AS pv,
           first_value(CASE WHEN value IS NOT NULL THEN r END IGNORE NULLS) OVER down AS nr, first_value(value IGNORE NULLS) OVER down AS nv
    FROM f1 WINDOW up AS (PARTITION BY sensor_id ORDER BY date ROWS UNBOUNDED PRECEDING), down AS (PARTITION BY sensor_id ORDER BY date ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))"""
_FILLED = "SELECT sensor_id, date, coalesce(value, pv + (nv - pv) / nullif(nr - pr, 0) * (r - pr), pv, nv) AS value FROM f2"
add("diagnose_extremes", "n_extreme@i share@d", lambda s, d: C.diagnose_extremes(T.readings_extreme(s, d)), T.EXTREME + _CHANGE, "SELECT count(*) FILTER (x) AS n_extreme, avg(x::int) AS share FROM c1")
add("filter_extremes", _KEYS + "value@d", lambda s, d: C.filter_extremes(T.readings_extreme(s, d)), T.EXTREME + _CHANGE + ", f0 AS (SELECT sensor_id, date, CASE WHEN NOT x THEN value END AS value FROM c1)" + _FILL, _FILLED)
add("interpolate_gaps", _KEYS + "value@d", lambda s, d: C.interpolate_gaps(T.readings_full(s, d)), T.FULL + ", f0 AS (SELECT * FROM readings_full)" + _FILL, _FILLED)
_FIVE = "(PARTITION BY sensor_id ORDER BY date ROWS 4 PRECEDING)"
add("smooth_speeds", _KEYS + "value@d", lambda s, d: C.smooth_speeds(T.readings(s, d)), T.READINGS, f"SELECT sensor_id, date, avg(value) OVER {_FIVE} AS value FROM readings")
add("smooth_speeds_median", _KEYS + "value@d", lambda s, d: C.smooth_speeds(T.readings(s, d), median=True), T.READINGS, f"SELECT sensor_id, date, median(value) OVER {_FIVE} AS value FROM readings")
add("smooth_train_test_separately", _KEYS + "value@d", lambda s, d: C.smooth_train_test_separately(T.readings_split(s, d)), T.SPLIT, "SELECT sensor_id, date, avg(value) OVER (PARTITION BY sensor_id, test_set ORDER BY date ROWS 4 PRECEDING) AS value FROM split")
add("elapsed_minutes", _KEYS + "elapsed_minutes@d", lambda s, d: C.elapsed_minutes(T.readings(s, d)), T.READINGS, "SELECT sensor_id, date, epoch(date - min(date) OVER (PARTITION BY sensor_id)) / 60 AS elapsed_minutes FROM readings")
add("grid_readings", _KEYS + "value@d", lambda s, d: C.grid_readings(T.readings_irregular(s, d), "day"), T.IRREGULAR, "SELECT sensor_id, date_trunc('day', date) AS date, avg(value) AS value FROM irregular GROUP BY 1, 2")

# 2.5 Encoders and calendar columns
_TRAIN = T.SPLIT + ", train AS (SELECT * FROM split WHERE NOT test_set AND sensor_id <> 'S07')"
_train = lambda s, d: T.readings_split(s, d).filter("not test_set and sensor_id <> 'S07'")  # noqa: E731  S07 is unseen
add("encode_sensor_ordinal", _KEYS + "sensor_uid@i", lambda s, d: X.encode_sensor_ordinal(T.readings(s, d), X.fit_ordinal(_train(s, d))), _TRAIN + ", u AS (SELECT sensor_id, row_number() OVER (ORDER BY sensor_id) - 1 AS uid FROM (SELECT DISTINCT sensor_id FROM train))", "SELECT sensor_id, date, coalesce(uid, -1) AS sensor_uid FROM readings LEFT JOIN u USING (sensor_id)")
add("encode_sensor_mean", _KEYS + "sensor_mean@d", lambda s, d: X.encode_sensor_mean(T.readings(s, d), X.fit_mean(_train(s, d))), _TRAIN + ", u AS (SELECT sensor_id, avg(value) AS m FROM train GROUP BY 1)", "SELECT sensor_id, date, coalesce(m, (SELECT avg(value) FROM train)) AS sensor_mean FROM readings LEFT JOIN u USING (sensor_id)")
add("encode_sensor_onehot", _KEYS + "sensor_S01@i sensor_S02@i", lambda s, d: X.encode_sensor_onehot(T.readings(s, d), ["S02", "S00", "S01"]), T.READINGS, "SELECT *, (sensor_id = 'S01')::int AS \"sensor_S01\", (sensor_id = 'S02')::int AS \"sensor_S02\" FROM readings")
add("calendar_features", _KEYS + "hour@i day@i month@i is_saturday@i is_sunday@i", lambda s, d: X.calendar_features(T.readings(s, d)), T.READINGS, "SELECT sensor_id, date, hour(date) AS hour, isodow(date) - 1 AS day, month(date) AS month, (isodow(date) = 6)::int AS is_saturday, (isodow(date) = 7)::int AS is_sunday FROM readings")
_circle = lambda e, p, n: f"sin({e} * (2 * pi() / {p})) AS {n.replace('*', 'sin')}, cos({e} * (2 * pi() / {p})) AS {n.replace('*', 'cos')}"
add(
    "cyclical_time", _KEYS + " ".join(f"{p}_{x}_{f}@d" for p in ("dow", "hour", "minute") for x in ("curr", "tgt") for f in ("sin", "cos")),
    lambda s, d: H.renamed(X.cyclical_time(T.readings(s, d), 90), lambda c: c.replace("_curr_sin", "_curr_sin")), T.READINGS + ", ahead AS (SELECT *, date + INTERVAL 90 MINUTE AS t FROM readings)",
    "SELECT sensor_id, date, " + ", ".join(_circle(e.format(v), p, f"{n}_{x}_*") for v, x in (("date", "curr"), ("t", "tgt")) for e, p, n in (("(isodow({0}) - 1)", 7, "dow"), ("hour({0})", 24, "hour"), ("minute({0})", 60, "minute"))) + " FROM ahead",
)
add(
    "time_encodings", _KEYS + " ".join(f"{x}{p}_{f}@d" for p in ("minute", "hour", "dow", "month") for x in ("", "pred_") for f in ("sin", "cos")),
    lambda s, d: X.time_encodings(T.readings(s, d), 90), T.READINGS + ", ahead AS (SELECT *, date + INTERVAL 90 MINUTE AS t FROM readings)",
    "SELECT sensor_id, date, " + ", ".join(_circle(e.format(v), p, f"{x}{n}_*") for v, x in (("date", ""), ("t", "pred_")) for e, p, n in (("(isodow({0}) - 1)", 7, "dow"), ("hour({0})", 24, "hour"), ("minute({0})", 60, "minute"), ("(month({0}) - 1)", 12, "month"))) + " FROM ahead",
)
add("time_index_features", _KEYS + "day_index@i slot_index@i", lambda s, d: X.time_index_features(T.readings_irregular(s, d)), T.IRREGULAR, "SELECT sensor_id, date, isodow(date) - 1 AS day_index, (hour(date) * 60 + minute(date)) // 5 % 288 AS slot_index FROM irregular")
add("business_flags", _KEYS + "is_business_hour@i is_weekend@i is_holiday@i", lambda s, d: X.business_flags(T.readings(s, d), ["2024-01-01"]), T.READINGS, "SELECT sensor_id, date, (hour(date) BETWEEN 8 AND 18)::int AS is_business_hour, (isodow(date) >= 6)::int AS is_weekend, (date::date = DATE '2024-01-01')::int AS is_holiday FROM readings")

# 2.6 Joins and neighbour lookups
_edges = lambda s, d: T.edges(s, T.readings(s, d))
_NB = ", nb AS (SELECT r.sensor_id, r.date, r.value, " + ", ".join(f"max(v.value) FILTER (e.direction = '{x}' AND e.k = {k}) AS {x}{k}, max(e.distance) FILTER (e.direction = '{x}' AND e.k = {k} AND v.value IS NOT NULL) AS {x}{k}_m" for x in ("down", "up") for k in (1, 2)) + " FROM readings r LEFT JOIN edges e ON e.sensor_id = r.sensor_id LEFT JOIN readings v ON v.sensor_id = e.neighbor_id AND v.date = r.date GROUP BY ALL)"
_ADJ = " ".join(f"{x}stream_sensor_{k}@d" for x in ("down", "up") for k in (1, 2))
add("adjacent_values", _KEYS + _ADJ, lambda s, d: G.adjacent_values(T.readings(s, d), _edges(s, d), 2), T.EDGES + _NB, "SELECT sensor_id, date, " + ", ".join(f"coalesce({x}{k}, -1) AS {x}stream_sensor_{k}" for x in ("down", "up") for k in (1, 2)) + " FROM nb")
add(
    "adjacent_values_relative", _KEYS + _ADJ, lambda s, d: G.adjacent_values(T.readings(s, d), _edges(s, d), 2, relative=True, by_distance=True), T.EDGES + _NB,
    "SELECT sensor_id, date, " + ", ".join([f"coalesce((down{k} - value) / (value + 1e-5) / 3.6 / down{k}_m, -1) AS downstream_sensor_{k}, coalesce((value - up{k}) / (up{k} + 1e-5) / 3.6 / up{k}_m, -1) AS upstream_sensor_{k}" for k in (1, 2)]) + " FROM nb",
)
_CONG = ", thr AS (SELECT sensor_id, quantile_cont(value, 0.9) * 0.65 AS threshold FROM split WHERE NOT test_set AND hour(date) BETWEEN 6 AND 19 GROUP BY 1), cong AS (SELECT s.*, coalesce(value < threshold AND hour(date) BETWEEN 6 AND 19, false)::int AS is_congested FROM split s LEFT JOIN thr USING (sensor_id))"
_congested = lambda s, d: X.congestion_flag(T.readings_split(s, d), X.fit_congestion(T.readings_split(s, d).filter("not test_set")))
_SPLIT_EDGES = T.EDGES + ", split AS (SELECT *, date >= TIMESTAMP '2024-01-21' AS test_set FROM readings)"
add(
    "adjacent_congestion", _KEYS + "downstream_sensor_congested_1@d upstream_sensor_congested_1@d", lambda s, d: G.adjacent_congestion(_congested(s, d), _edges(s, d), 1), _SPLIT_EDGES + _CONG,
    "SELECT r.sensor_id, r.date, max(v.is_congested) FILTER (e.direction = 'down') AS downstream_sensor_congested_1, max(v.is_congested) FILTER (e.direction = 'up') AS upstream_sensor_congested_1 FROM cong r LEFT JOIN edges e ON e.sensor_id = r.sensor_id AND e.k = 1 LEFT JOIN cong v ON v.sensor_id = e.neighbor_id AND v.date = r.date GROUP BY ALL",
)
add("missing_neighbors", "sensor_id", lambda s, d: G.missing_neighbors(T.readings(s, d), _edges(s, d).filter("not (sensor_id = 'S03' and direction = 'up')")), T.EDGES, "SELECT DISTINCT sensor_id FROM readings WHERE sensor_id = 'S03'")
_TAU = ", flow AS (SELECT sensor_id, quantile_cont(value, 0.95) AS f FROM readings GROUP BY 1), taus AS (SELECT e.sensor_id, k, neighbor_id AS upstream, CASE WHEN f > 0 THEN f ELSE 100.0 END AS free_flow, greatest(1, round_even(greatest(0.0, least(distance / {unit} / (CASE WHEN f > 0 THEN f ELSE 100.0 END / 60), 30.0)) / 1, 0))::int AS tau FROM edges e LEFT JOIN flow ON flow.sensor_id = e.neighbor_id WHERE direction = 'up' AND neighbor_id IS NOT NULL)"
add("upstream_travel_time", "sensor_id k@i upstream free_flow@d tau@i", lambda s, d: G.upstream_travel_time(T.readings(s, d), _edges(s, d)), T.EDGES + _TAU.format(unit="1000.0"), "SELECT * FROM taus")
_UP = ", series AS (SELECT *, row_number() OVER w AS rn, value - lag(value) OVER w AS delta1, CASE WHEN count(value) OVER w3 = 3 THEN regr_slope(value, rn0) OVER w3 END AS slope3 FROM (SELECT *, row_number() OVER (PARTITION BY sensor_id ORDER BY date) AS rn0 FROM readings) WINDOW w AS (PARTITION BY sensor_id ORDER BY date), w3 AS (PARTITION BY sensor_id ORDER BY date ROWS 2 PRECEDING)), moved AS (SELECT t.sensor_id, b.date, a.value, a.delta1, a.slope3 FROM taus t JOIN series a ON a.sensor_id = t.upstream JOIN series b ON b.sensor_id = t.upstream AND b.rn = a.rn + t.tau WHERE t.k = 1)"
add(
    "upstream_shifted", _KEYS + "up1_shift_speed@d up1_shift_delta1@d up1_shift_slope_w3@d",
    lambda s, d: G.upstream_shifted(T.readings(s, d), G.upstream_travel_time(T.readings(s, d), _edges(s, d), as_km=True, cap_minutes=5), (3,)), T.EDGES + _TAU.format(unit="1.0").replace("30.0", "5.0") + _UP,
    "SELECT r.sensor_id, r.date, coalesce(m.value, -1) AS up1_shift_speed, coalesce(m.delta1, -1) AS up1_shift_delta1, coalesce(m.slope3, -1) AS up1_shift_slope_w3 FROM readings r LEFT JOIN moved m ON m.sensor_id = r.sensor_id AND m.date = r.date",
)
_LOOK = """, l0 AS (SELECT *, date + INTERVAL 1 HOUR - to_days(CASE WHEN isodow(date) = 1 THEN 3 WHEN isodow(date) >= 6 THEN 7 ELSE 1 END) AS a, CASE WHEN isodow(date) = 7 THEN date + INTERVAL 1 HOUR - to_days(1) END AS b FROM readings),
    look AS (SELECT l0.*, CASE WHEN r.date IS NULL THEN coalesce(b, a) ELSE a END AS t FROM l0 LEFT JOIN readings r ON r.sensor_id = l0.sensor_id AND r.date = l0.a)"""
_near = lambda o: f"LEFT JOIN readings r{o + 1} ON r{o + 1}.sensor_id = look.sensor_id AND r{o + 1}.date = look.t + to_hours({o})"
add("previous_weekday_window", _KEYS + "prev_wd_val_t-60@d prev_wd_val_t0@d prev_wd_val_t60@d", lambda s, d: G.previous_weekday_window(T.readings(s, d), 60), T.READINGS + _LOOK, 'SELECT look.sensor_id, look.date, r0.value AS "prev_wd_val_t-60", r1.value AS "prev_wd_val_t0", r2.value AS "prev_wd_val_t60" FROM look ' + " ".join(map(_near, (-1, 0, 1))))
add(
    "previous_weekday_local_agg", _KEYS + "mean_local@d min_local@d max_local@d std_local@d median_local@d", lambda s, d: G.previous_weekday_local_agg(T.readings(s, d), 60), T.READINGS + _LOOK,
    "SELECT look.sensor_id, look.date, avg(v.value) AS mean_local, min(v.value) AS min_local, max(v.value) AS max_local, stddev_samp(v.value) AS std_local, median(v.value) AS median_local FROM look LEFT JOIN readings v ON v.sensor_id = look.sensor_id AND v.date BETWEEN look.t - INTERVAL 1 HOUR AND look.t + INTERVAL 1 HOUR GROUP BY 1, 2",
)
add(
    "previous_weekday_climatology", _KEYS + "prev_wd_mean_0_0@d prev_wd_median_0_0@d", lambda s, d: G.previous_weekday_climatology(T.readings(s, d), 60), T.READINGS + _LOOK + ", clim AS (SELECT sensor_id, strftime(date, '%H:%M') AS hm, avg(value) AS m, median(value) AS q FROM readings GROUP BY 1, 2)",
    "SELECT look.sensor_id, look.date, m AS prev_wd_mean_0_0, q AS prev_wd_median_0_0 FROM look LEFT JOIN (SELECT DISTINCT date FROM readings) x ON x.date = look.t LEFT JOIN clim ON clim.sensor_id = look.sensor_id AND clim.hm = strftime(x.date, '%H:%M')",
)
add(
    "previous_weekday_value", _KEYS + "prev_weekday_value@d", lambda s, d: G.previous_weekday_value(T.readings(s, d), 60), T.READINGS,
    "SELECT r.sensor_id, r.date, v.value AS prev_weekday_value FROM readings r LEFT JOIN readings v ON v.sensor_id = r.sensor_id AND v.date = r.date - to_days(CASE isodow(r.date) WHEN 1 THEN 3 WHEN 7 THEN 2 ELSE 1 END) + INTERVAL 1 HOUR",
)
add("merge_external_predictions", _KEYS + "value@d gman_prediction@d gman_prediction_orig@d", lambda s, d: G.merge_external_predictions(T.readings(s, d), T.external_predictions(s, d), as_delta=True), T.EXTERNAL, "SELECT r.sensor_id, r.date, r.value, gman_prediction - r.value AS gman_prediction, gman_prediction AS gman_prediction_orig FROM readings r LEFT JOIN external e ON e.sensor_id = r.sensor_id AND e.gman_prediction_date = r.date")
_persist = lambda s, d: T.predictions(s, d).filter("model = 'persist'")
_drift = lambda s, d, h=1: T.predictions(s, d).filter(f"model = 'drift' and horizon = {h}")
add(
    "merge_horizon_predictions", _KEYS + "y@d y_pred_1@d y_pred_3@d", lambda s, d: G.merge_horizon_predictions(T.predictions(s, d).filter("model = 'drift'"), [1, 3]), T.PREDICTIONS,
    "SELECT sensor_id, date, max(y) FILTER (horizon = 1) AS y, max(y_pred) FILTER (horizon = 1) AS y_pred_1, max(y_pred) FILTER (horizon = 3) AS y_pred_3 FROM predictions WHERE model = 'drift' GROUP BY 1, 2",
)
add("attach_actuals", "sensor_id prediction_time@t y_pred@d y_act_total@d", lambda s, d: G.attach_actuals(_drift(s, d).select("sensor_id", "prediction_time", "y_pred"), T.readings(s, d), "value"), T.PREDICTIONS, "SELECT p.sensor_id, p.prediction_time, p.y_pred, r.value AS y_act_total FROM predictions p LEFT JOIN readings r ON r.sensor_id = p.sensor_id AND r.date = p.prediction_time WHERE model = 'drift' AND horizon = 1")
add(
    "prediction_parity", "n_common@i mean_abs_diff@d max_abs_diff@d", lambda s, d: G.prediction_parity(_drift(s, d), _persist(s, d).filter("horizon = 1"), "y_pred"), T.PREDICTIONS,
    "SELECT count(*) AS n_common, avg(abs(a.y_pred - b.y_pred)) AS mean_abs_diff, max(abs(a.y_pred - b.y_pred)) AS max_abs_diff FROM predictions a JOIN predictions b USING (sensor_id, prediction_time) WHERE a.model = 'drift' AND b.model = 'persist' AND a.horizon = 1 AND b.horizon = 1",
)

# 2.7 Lag, target and momentum features
add("lag_features", _KEYS + " ".join(f"relative_diff_lag{i}@d" for i in range(1, 26)), lambda s, d: X.lag_features(T.readings(s, d)), T.READINGS, "SELECT sensor_id, date, " + ", ".join(f"coalesce((value - lag(value, {i}) OVER w) / (lag(value, {i}) OVER w + 1e-5), -1) AS relative_diff_lag{i}" for i in range(1, 26)) + " FROM readings" + _W)
add("lag_features_absolute", _KEYS + "diff_lag1@d diff_lag2@d", lambda s, d: X.lag_features(T.readings_irregular(s, d).groupBy("sensor_id", "date").agg(F.max("value").alias("value")), 2, relative=False), T.IRREGULAR + ", i AS (SELECT sensor_id, date, max(value) AS value FROM irregular GROUP BY 1, 2)", "SELECT sensor_id, date, coalesce(lag(value) OVER w - value, -1) AS diff_lag1, coalesce(lag(value, 2) OVER w - value, -1) AS diff_lag2 FROM i" + _W)
_TARGET = ", t0 AS (SELECT *, lead(value, 3) OVER w AS total, lead(date, 3) OVER w AS pt FROM readings" + _W + ")"
add(
    "lag_features_chunked", _KEYS + " ".join(f"relative_diff_lag{i}@d" for i in range(1, 4)), lambda s, d: in_chunks(T.readings(s, d), lambda df, cols: X.lag_features(df, 3, cols=cols), 120, 240), T.READINGS,
    "SELECT sensor_id, date, " + ", ".join(f"coalesce((value - lag(value, {i}) OVER w) / (lag(value, {i}) OVER w + 1e-5), -1) AS relative_diff_lag{i}" for i in range(1, 4)) + " FROM readings" + _W,
)
add("create_target", _KEYS + "target_total_speed@d target_speed_delta@d target@d prediction_time@t", lambda s, d: X.create_target(T.readings(s, d), 3), T.READINGS + _TARGET, "SELECT sensor_id, date, total AS target_total_speed, total - value AS target_speed_delta, total - value AS target, pt AS prediction_time FROM t0 WHERE total IS NOT NULL")
add("check_monotonic", "sensor_id n_back@i", lambda s, d: C.check_monotonic(T.readings_irregular(s, d).withColumn("arrival", (F.col("event_id") % 7) * 10_000_000 + F.col("event_id")), "arrival"), T.IRREGULAR, "SELECT sensor_id, count(*) AS n_back FROM (SELECT sensor_id, date < lag(date) OVER (PARTITION BY sensor_id ORDER BY event_id % 7, event_id) AS b FROM irregular) WHERE b GROUP BY 1")
add("validate_target", "n_rows@i n_mismatch@i", lambda s, d: X.validate_target(T.readings(s, d), X.create_target(T.readings(s, d), 3).withColumn("target_speed_delta", F.col("target_speed_delta") + F.when(F.hour("date") == 4, 1.0).otherwise(0.0)), 3), T.READINGS + _TARGET, "SELECT count(*) AS n_rows, count(*) FILTER (hour(date) = 4) AS n_mismatch FROM t0 WHERE total IS NOT NULL")
_SLOPE = ", n0 AS (SELECT *, row_number() OVER w AS rn FROM readings" + _W + "), slopes AS (SELECT *, " + ", ".join(f"CASE WHEN count(value) OVER w{k} = {k} THEN regr_slope(value, rn) OVER w{k} END AS s{k}" for k in (5, 10)) + " FROM n0 WINDOW " + ", ".join(f"w{k} AS (PARTITION BY sensor_id ORDER BY date ROWS {k - 1} PRECEDING)" for k in (5, 10)) + ")"
add("rolling_slope", _KEYS + "slope_5@d slope_10@d", lambda s, d: X.rolling_slope(T.readings(s, d)), T.READINGS + _SLOPE, "SELECT sensor_id, date, coalesce(s5, -1) AS slope_5, coalesce(s10, -1) AS slope_10 FROM slopes")
_EWMA = "numbered AS (SELECT *, row_number() OVER w AS rn FROM readings" + _W + "), e AS (SELECT sensor_id, date, rn, value AS m, value FROM numbered WHERE rn = 1 UNION ALL SELECT n.sensor_id, n.date, n.rn, e.m * (1 - {a}) + {a} * n.value, n.value FROM e JOIN numbered n ON n.sensor_id = e.sensor_id AND n.rn = e.rn + 1)"
add("ewma_mean_slope", _KEYS + "ewm_mean_5@d ewm_slope_5@d", lambda s, d: X.ewma_mean_slope(T.readings(s, d)), "RECURSIVE " + T.READINGS + ", " + _EWMA.format(a="(1 - exp(ln(0.5) / 5))"), "SELECT sensor_id, date, m AS ewm_mean_5, coalesce(m - lag(m) OVER w, -1) AS ewm_slope_5 FROM e" + _W)
_TEN = "(PARTITION BY sensor_id ORDER BY date ROWS 9 PRECEDING)"
add("rolling_volatility", _KEYS + "std_10@d mad_10@d", lambda s, d: X.rolling_volatility(T.readings(s, d)), T.READINGS, f"SELECT sensor_id, date, CASE WHEN count(value) OVER x = 10 THEN stddev_samp(value) OVER x ELSE -1 END AS std_10, CASE WHEN count(value) OVER x = 10 THEN mad(value) OVER x ELSE -1 END AS mad_10 FROM readings WINDOW x AS {_TEN}")
add(
    "rolling_extrema", _KEYS + "min_10@d max_10@d dist_to_min_10@d dist_to_max_10@d", lambda s, d: X.rolling_extrema(T.readings(s, d)), T.READINGS + f", m AS (SELECT *, CASE WHEN count(value) OVER x = 10 THEN min(value) OVER x ELSE -1 END AS lo, CASE WHEN count(value) OVER x = 10 THEN max(value) OVER x ELSE -1 END AS hi FROM readings WINDOW x AS {_TEN})",
    "SELECT sensor_id, date, lo AS min_10, hi AS max_10, value - lo AS dist_to_min_10, hi - value AS dist_to_max_10 FROM m",
)
add("minutes_since_below", _KEYS + "minutes_since_below@i", lambda s, d: X.minutes_since_below(T.readings(s, d), 20.0, 60), T.READINGS + ", n0 AS (SELECT *, row_number() OVER w AS rn FROM readings" + _W + ")", "SELECT sensor_id, date, coalesce((rn - max(CASE WHEN value < 20 THEN rn END) OVER (PARTITION BY sensor_id ORDER BY date)) * 60, -1) AS minutes_since_below FROM n0")
add("fast_drop_flag", _KEYS + "fast_drop@i", lambda s, d: X.fast_drop_flag(T.readings(s, d), 5, -2.0), T.READINGS + _SLOPE, "SELECT sensor_id, date, (coalesce(s5, -1) < -2)::int AS fast_drop FROM slopes")
_against = lambda v, k, pre="": f"{v} - avg({v}) OVER x{k} AS {pre}dev_{k}, coalesce(({v} - avg({v}) OVER x{k}) / nullif(CASE WHEN count({v}) OVER x{k} > 1 THEN stddev_samp({v}) OVER x{k} END, 0), 0) AS {pre}z_{k}, {v} / nullif(avg({v}) OVER x{k}, 0) AS {pre}ratio_{k}"
add("rolling_context", _KEYS + "dev_6@d z_6@d ratio_6@d dev_24@d z_24@d ratio_24@d", lambda s, d: X.rolling_context(T.readings(s, d)), T.READINGS, f"SELECT sensor_id, date, {_against('value', 6)}, {_against('value', 24)} FROM readings WINDOW x6 AS (PARTITION BY sensor_id ORDER BY date ROWS 5 PRECEDING), x24 AS (PARTITION BY sensor_id ORDER BY date ROWS 23 PRECEDING)")
add(
    "rolling_context_long", _KEYS + "dev_240@d z_240@d ratio_240@d", lambda s, d: X.rolling_context(T.readings(s, d), (240,)), T.READINGS,
    f"SELECT sensor_id, date, {_against('value', 240)} FROM readings WINDOW x240 AS (PARTITION BY sensor_id ORDER BY date ROWS 239 PRECEDING)",
)
add("network_context", _KEYS + "network_mean@d network_dev_6@d network_z_6@d network_ratio_6@d", lambda s, d: X.network_context(T.readings(s, d), (6,)), T.READINGS + ", m AS (SELECT date, avg(value) AS network_mean FROM readings GROUP BY 1), c AS (SELECT date, network_mean, " + _against("network_mean", 6, "network_") + " FROM m WINDOW x6 AS (ORDER BY date ROWS 5 PRECEDING))", "SELECT * FROM readings JOIN c USING (date)")
_DYN = f"""RECURSIVE {T.READINGS}, numbered AS (SELECT *, row_number() OVER w AS rn FROM readings{_W}), e AS (
    SELECT sensor_id, date, rn, value AS fast, value AS slow FROM numbered WHERE rn = 1
    UNION ALL SELECT n.sensor_id, n.date, n.rn, e.fast * 0.5 + 0.5 * n.value, e.slow * (1 - 2.0 / 13) + 2.0 / 13 * n.value FROM e JOIN numbered n ON n.sensor_id = e.sensor_id AND n.rn = e.rn + 1
), st AS (SELECT median(epoch(date - p)) AS step FROM (SELECT date, lag(date) OVER w AS p FROM readings{_W})), a AS (
    SELECT readings.*, (value / 3.6 - lag(value / 3.6, 3) OVER w) / (step * 3) AS acceleration, {_against('value', 3)}, {_against('value', 6)}, value - min(value) OVER x3 AS dist_to_roll_min, step
    FROM readings, st WINDOW w AS (PARTITION BY sensor_id ORDER BY date), x3 AS (PARTITION BY sensor_id ORDER BY date ROWS 2 PRECEDING), x6 AS (PARTITION BY sensor_id ORDER BY date ROWS 5 PRECEDING))"""
add(
    "short_term_dynamics", _KEYS + "acceleration@d jerk@d short_z_3@d short_z_6@d dist_to_roll_min@d ema_spread@d drop_warning@i", lambda s, d: X.short_term_dynamics(T.readings(s, d)), _DYN,
    "SELECT a.sensor_id, a.date, acceleration, (acceleration - lag(acceleration, 3) OVER (PARTITION BY a.sensor_id ORDER BY a.date)) / (step * 3) AS jerk, z_3 AS short_z_3, z_6 AS short_z_6, dist_to_roll_min, fast - slow AS ema_spread, (least(z_3, z_6) < -1)::int AS drop_warning FROM a JOIN e ON e.sensor_id = a.sensor_id AND e.date = a.date",
)

# 2.8 Aggregations and thresholds
add("congestion_flag", _KEYS + "is_congested@i", _congested, T.SPLIT + _CONG, "SELECT * FROM cong")
add("outlier_flag", _KEYS + "is_outlier@i", lambda s, d: X.outlier_flag(T.readings(s, d), X.fit_outlier(T.readings_split(s, d).filter("not test_set"))), T.SPLIT + ", q AS (SELECT quantile_cont(value, 0.01) AS lo, quantile_cont(value, 0.99) AS hi FROM split WHERE NOT test_set)", "SELECT sensor_id, date, (value < lo OR value > hi)::int AS is_outlier FROM split, q")
add("train_stats", "sensor_id min@d max@d var@d mean@d", lambda s, d: X.train_stats(T.readings_split(s, d).filter("not test_set")), T.SPLIT, "SELECT sensor_id, min(value) AS min, max(value) AS max, var_samp(value) AS var, avg(value) AS mean FROM split WHERE NOT test_set GROUP BY 1")
add("correlation_select", "column correlation@d", lambda s, d: P.correlation_select(X.calendar_features(X.lag_features(T.readings(s, d), 3)), ["relative_diff_lag1", "relative_diff_lag2", "hour", "day"], 0.1), T.READINGS + ", f AS (SELECT *, coalesce((value - lag(value) OVER w) / (lag(value) OVER w + 1e-5), -1) AS a, coalesce((value - lag(value, 2) OVER w) / (lag(value, 2) OVER w + 1e-5), -1) AS b FROM readings" + _W + "), c AS (SELECT corr(a, value) AS a, corr(b, value) AS b, corr(hour(date), value) AS h, corr(isodow(date), value) AS d FROM f)", " UNION ALL ".join(f"SELECT '{n}' AS \"column\", {k} AS correlation FROM c WHERE abs({k}) >= 0.1" for n, k in (("relative_diff_lag1", "a"), ("relative_diff_lag2", "b"), ("hour", "h"), ("day", "d"))))
_SPEARMAN = ["relative_diff_lag1", "relative_diff_lag2", "hour", "day"]
add(
    "correlation_select_spearman", "column correlation@d", lambda s, d: P.correlation_select(X.calendar_features(X.lag_features(T.readings(s, d), 3)), _SPEARMAN, 0.01, "spearman"),
    T.READINGS + ", f AS (SELECT value, coalesce((value - lag(value) OVER w) / (lag(value) OVER w + 1e-5), -1) AS relative_diff_lag1, coalesce((value - lag(value, 2) OVER w) / (lag(value, 2) OVER w + 1e-5), -1) AS relative_diff_lag2, "
    "hour(date) AS hour, isodow(date) AS day FROM readings" + _W + "), k AS (SELECT " + ", ".join(f"rank() OVER (ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1) / 2.0 AS {c}" for c in ("value", *_SPEARMAN)) + " FROM f), "
    "c AS (SELECT " + ", ".join(f"corr({c}, value) AS {c}" for c in _SPEARMAN) + " FROM k)",
    " UNION ALL ".join(f"SELECT '{c}' AS \"column\", {c} AS correlation FROM c WHERE abs({c}) >= 0.01" for c in _SPEARMAN),
)


def _correlated(spark: SparkSession, d: str) -> DataFrame:
    """The rows if ``half`` alone is selected; none if the tables select other columns."""
    rows = X.calendar_features(T.readings(spark, d)).withColumn("half", F.col("value") / 2 - F.hour("date"))
    kept = P.keep_correlated(rows, ["half", "hour"], 0.5)
    if {"half", "hour"} & set(kept.columns) == {"half"}:
        return kept
    return kept.withColumn("half", F.lit(None).cast("double")).filter("false")


add(
    "keep_correlated", _KEYS + "value@d half@d", _correlated, T.READINGS
    + ", c AS (SELECT abs(corr(value / 2 - hour(date), value)) >= 0.5 AND abs(corr(hour(date), value)) < 0.5 AS right_ones FROM readings)", "SELECT sensor_id, date, value, value / 2 - hour(date) AS half FROM readings, c WHERE right_ones",
)
add("standardize", _KEYS + "value@d", lambda s, d: P.standardize(T.readings(s, d), T.readings_split(s, d).filter("not test_set"), ["value"]), T.SPLIT + ", m AS (SELECT avg(value) AS a, stddev_pop(value) AS b FROM split WHERE NOT test_set)", "SELECT sensor_id, date, (value - a) / b AS value FROM split, m")
add("standardize_minmax", _KEYS + "value@d", lambda s, d: P.standardize(T.readings(s, d), T.readings(s, d), ["value"], minmax=True), T.READINGS, "SELECT sensor_id, date, (value - min(value) OVER ()) / (max(value) OVER () - min(value) OVER ()) AS value FROM readings")
_target1 = lambda s, d: X.create_target(T.readings(s, d), 1)
_T1 = T.READINGS + ", t1 AS (SELECT *, lead(value) OVER w - value AS target FROM readings" + _W + "), sc AS (SELECT sensor_id, avg(target) AS m, sqrt(greatest(var_pop(target), 1e-8)) AS s FROM t1 WHERE target IS NOT NULL GROUP BY 1)"
add("label_scaling", _KEYS + "target_scaled@d target@d", lambda s, d: P.label_scaling(P.label_scaling(_target1(s, d), P.fit_label_scaling(_target1(s, d))), P.fit_label_scaling(_target1(s, d)), back=True), _T1, "SELECT sensor_id, date, (target - m) / s AS target_scaled, target FROM t1 JOIN sc USING (sensor_id) WHERE target IS NOT NULL")
add("split_date_gaps", "min_a@t max_a@t min_b@t max_b@t min_gap@d max_gap@d", lambda s, d: S.split_date_gaps(T.readings_split(s, d).filter("not test_set"), T.readings_split(s, d).filter("test_set")), T.SPLIT + ", g AS (SELECT min(date) FILTER (NOT test_set) AS min_a, max(date) FILTER (NOT test_set) AS max_a, min(date) FILTER (test_set) AS min_b, max(date) FILTER (test_set) AS max_b FROM split)", "SELECT *, epoch(min_b - min_a) / 60 AS min_gap, epoch(max_b - max_a) / 60 AS max_gap FROM g")
add("null_report", "sensor_id@i date@i value@i", lambda s, d: C.null_report(T.readings_full(s, d)), T.FULL, "SELECT count(*) FILTER (sensor_id IS NULL) AS sensor_id, count(*) FILTER (date IS NULL) AS date, count(*) FILTER (value IS NULL) AS value FROM readings_full")

# 2.9 Reshape, windows as rows
add("to_wide", f"date@t {_ALL} test_set", lambda s, d: P.to_wide(T.readings_split(s, d), T.SENSORS), T.SPLIT, "SELECT date, " + ", ".join(f"max(value) FILTER (sensor_id = '{x}') AS {x}" for x in T.SENSORS) + ", max(test_set) AS test_set FROM split GROUP BY 1")
_known = lambda s, d: X.fit_ordinal(T.readings(s, d).filter("sensor_id <> 'S03'"))  # noqa: E731  S03 has no place
_shown_list = lambda df, c: df.withColumn(c, F.concat_ws(",", F.transform(c, lambda x: F.when(x.isNull(), "-").otherwise(F.format_string("%.4f", x)))))
_UID = ", u AS (SELECT sensor_id, row_number() OVER (ORDER BY sensor_id) - 1 AS uid FROM (SELECT DISTINCT sensor_id FROM readings WHERE sensor_id <> 'S03'))"
add(
    "to_wide_arrays", "date@t sensors value", lambda s, d: _shown_list(P.wide_arrays(T.readings(s, d), _known(s, d)), "value").withColumn("sensors", F.concat_ws(",", F.col("sensors").cast("array<string>"))), T.READINGS + _UID,
    "SELECT date, string_agg(uid::varchar, ',' ORDER BY uid) AS sensors, string_agg(printf('%.4f', value), ',' ORDER BY uid) AS value FROM readings JOIN u USING (sensor_id) GROUP BY 1",
)
add(
    "to_wide_dense", "date@t value", lambda s, d: _shown_list(P.dense_arrays(P.wide_arrays(T.readings(s, d), _known(s, d)), 7, ("value",)), "value"), T.READINGS + _UID,
    "SELECT d.date, string_agg(coalesce(printf('%.4f', r.value), '-'), ',' ORDER BY uid) AS value FROM (SELECT DISTINCT date FROM readings JOIN u USING (sensor_id)) d CROSS JOIN u LEFT JOIN readings r ON r.sensor_id = u.sensor_id AND r.date = d.date GROUP BY 1",
)
add(
    "melt_external_predictions", "sensor_id gman_prediction@d gman_prediction_date@t gman_target_date@t", lambda s, d: P.melt_external_predictions(T.wide_predictions(s, d), T.SENSORS, minutes_per_step=60), T.WIDE,
    " UNION ALL ".join(f"SELECT '{x}' AS sensor_id, {x}_pred AS gman_prediction, timestamp - INTERVAL 3 HOUR AS gman_prediction_date, timestamp AS gman_target_date FROM wide WHERE timestep = 2" for x in T.SENSORS),
)
_WIDE_COLUMNS = [(x, c, n) for x in T.SENSORS for c, n in (("y", ""), ("y_pred", "_pred"), ("value", "_at_issued_time"))]
add(
    "predictions_to_wide", "date@t prediction_time@t " + " ".join(f"{x}{n}@d" for x, _, n in _WIDE_COLUMNS), lambda s, d: H.rounded(P.predictions_to_wide(_repeated(s, d), T.SENSORS, order="seq"), 2),
    T.PREDICTIONS + ", one AS (SELECT * REPLACE (CASE WHEN hour(date) % 3 = 0 THEN y_pred - 5 ELSE y_pred END AS y_pred) FROM predictions WHERE model = 'drift' AND horizon = 1)",
    "SELECT date, prediction_time, " + ", ".join(f"round(max({c}) FILTER (sensor_id = '{x}')::float, 2) AS {x}{n}" for x, c, n in _WIDE_COLUMNS) + " FROM one GROUP BY 1, 2",
)


def _four(x: Column) -> Column:
    """A double as by %.4f; values of usual size by way of decimals, which round the same digits the same way and take a fraction of the time."""
    return F.when(F.abs(x).between(1e-3, 1e6), x.cast("decimal(18,4)").cast("string")).otherwise(F.format_string("%.4f", x))


_hist = lambda df, c: df.withColumn(c, F.concat_ws(",", F.transform(c, _four)))
add(
    "seq_windows", _KEYS + "target_time@t history target@d", lambda s, d: _hist(P.seq_windows(T.readings(s, d), 4, 2), "history"), T.READINGS + ", r AS (SELECT * FROM readings), h AS (SELECT *, row_number() OVER w - 1 AS i, array_agg(value) OVER (PARTITION BY sensor_id ORDER BY date ROWS 3 PRECEDING) AS hist, lead(value, 2) OVER w AS t, lead(date, 2) OVER w AS tt FROM r" + _W + ")",
    "SELECT sensor_id, date, tt AS target_time, array_to_string(list_transform(hist, lambda x: printf('%.4f', x)), ',') AS history, t - value AS target FROM h WHERE i >= 3 AND t IS NOT NULL",
)
add(
    "seq2seq_windows", "sensor_id start@t x y", lambda s, d: _hist(_hist(P.seq2seq_windows(T.readings(s, d),3, 2), "x"), "y"), T.READINGS + ", r AS (SELECT * FROM readings), h AS (SELECT *, array_agg(value) OVER (PARTITION BY sensor_id ORDER BY date ROWS BETWEEN CURRENT ROW AND 2 FOLLOWING) AS a, array_agg(value) OVER (PARTITION BY sensor_id ORDER BY date ROWS BETWEEN 3 FOLLOWING AND 4 FOLLOWING) AS b FROM r)",
    "SELECT sensor_id, date AS start, array_to_string(list_transform(a, lambda v: printf('%.4f', v)), ',') AS x, array_to_string(list_transform(b, lambda v: printf('%.4f', v)), ',') AS y FROM h WHERE len(a) = 3 AND len(b) = 2",
)
for _name, _op in {
    "seq_windows": lambda df: _hist(P.seq_windows(df, 4, 2, hours=48), "history"),
    "seq2seq_windows": lambda df: _hist(_hist(P.seq2seq_windows(df, 3, 2, hours=48), "x"), "y"),
}.items():
    QUERIES[f"{_name}_chunked"] = lambda s, d, op=_op, name=_name: _shown(op(T.readings(s, d)), SPECS[name])
    SPECS[f"{_name}_chunked"], ORACLE_SQL[f"{_name}_chunked"] = SPECS[_name], ORACLE_SQL[_name]
add(
    "window_split_counts", "split n_windows@i", lambda s, d: P.window_split_counts(P.seq_windows(T.readings(s, d), 4, 2), S.target_splits(T.readings_split(s, d))), T.SPLIT + _TARGET_SPLITS + ", h AS (SELECT row_number() OVER w - 1 AS i, lead(date, 2) OVER w AS tt FROM readings" + _W + ")",
    "SELECT split, count(*) AS n_windows FROM h JOIN splits ON splits.date = h.tt WHERE i >= 3 GROUP BY 1",
)
add(
    "explode_step_predictions", _KEYS + "timestep@i y@d y_pred@d",
    lambda s, d: P.explode_step_predictions(H.step_arrays(T.step_predictions(s, d)), ["sensor_id", "date"]), T.STEPS, "SELECT * FROM steps WHERE (sensor_id, date) IN (SELECT (sensor_id, date) FROM steps GROUP BY sensor_id, date HAVING count(*) = 3)",
)
add("assemble_results", "sensor_id issue_time@t target_time@t base@d actual@d pred@d", lambda s, d: P.assemble_results(_drift(s, d).withColumns({"y": F.col("y") - F.col("value"), "y_pred": F.col("y_pred") - F.col("value")}), 60), T.PREDICTIONS, "SELECT sensor_id, date AS issue_time, date + INTERVAL 1 HOUR AS target_time, value AS base, y - value + value AS actual, y_pred - value + value AS pred FROM predictions WHERE model = 'drift' AND horizon = 1")
add("concat_parts", _KEYS + "value@d", lambda s, d: P.concat_parts([T.readings_split(s, d).filter("test_set"), T.readings(s, d).filter("date < '2024-01-21'")]), T.READINGS, "SELECT * FROM readings")
add("trim_warmup", _KEYS + "value@d", lambda s, d: C.trim_warmup(T.readings(s, d), 25), T.READINGS, "SELECT * FROM readings QUALIFY row_number() OVER (PARTITION BY sensor_id ORDER BY date) > 25")

# 2.10 Predictions
add(
    "build_training_tables", "horizon@i test_set " + _KEYS + "value@d relative_diff_lag1@d downstream_sensor_1@d is_congested@i prev_wd_val_t0@d target@d", J.build_query, _SPLIT_EDGES.replace("FROM readings)", "FROM readings)", 1) + """, sm AS (
        SELECT sensor_id, date, test_set, avg(value) OVER (PARTITION BY sensor_id, test_set ORDER BY date ROWS 4 PRECEDING) AS value FROM split
    ), thr AS (SELECT sensor_id, quantile_cont(value, 0.9) * 0.65 AS threshold FROM sm WHERE NOT test_set AND hour(date) BETWEEN 6 AND 19 GROUP BY 1
    ), base AS (
        SELECT s.*, coalesce((s.value - lag(s.value) OVER w) / (lag(s.value) OVER w + 1e-5), -1) AS relative_diff_lag1, coalesce(n.value, -1) AS downstream_sensor_1,
               coalesce(s.value < threshold AND hour(s.date) BETWEEN 6 AND 19, false)::int AS is_congested, h.horizon,
               CASE h.horizon WHEN 1 THEN lead(s.value, 1) OVER w ELSE lead(s.value, 3) OVER w END AS total
        FROM sm s CROSS JOIN (VALUES (1), (3)) h(horizon) LEFT JOIN thr USING (sensor_id) LEFT JOIN edges e ON e.sensor_id = s.sensor_id AND e.direction = 'down' AND e.k = 1
        LEFT JOIN sm n ON n.sensor_id = e.neighbor_id AND n.date = s.date WINDOW w AS (PARTITION BY s.sensor_id, h.horizon ORDER BY s.date)
    ), l0 AS (SELECT *, date + to_hours(horizon) - to_days(CASE WHEN isodow(date) = 1 THEN 3 WHEN isodow(date) >= 6 THEN 7 ELSE 1 END) AS a, CASE WHEN isodow(date) = 7 THEN date + to_hours(horizon) - to_days(1) END AS b FROM base
    ), look AS (SELECT l0.*, CASE WHEN r.date IS NULL THEN coalesce(b, a) ELSE a END AS t FROM l0 LEFT JOIN sm r ON r.sensor_id = l0.sensor_id AND r.date = l0.a)""",
    "SELECT horizon, look.test_set, look.sensor_id, look.date, look.value, relative_diff_lag1, downstream_sensor_1, is_congested, v.value AS prev_wd_val_t0, total - look.value AS target FROM look LEFT JOIN sm v ON v.sensor_id = look.sensor_id AND v.date = look.t WHERE total IS NOT NULL",
)
add("fit_tree_model", _KEYS + "prediction@d target@d", J.fit_query)
add("grid_search_ts", "max_depth@i step_size@d max_iter@i mae@d best", J.grid_query)
add("batch_score", _KEYS + "y_pred_total@d", J.score_query)
# A stored model in its text form, scored by generated code here and as SQL there.
_MODEL = """
  Tree 0 (weight 1.0):
    If (feature 0 <= 41.625)
     If (feature 1 <= 6.5)
      Predict: 3.25
     Else (feature 1 > 6.5)
      Predict: -1.875
    Else (feature 0 > 41.625)
     Predict: -7.5
  Tree 1 (weight 0.1):
    If (feature 2 <= -0.125)
     If (feature 0 <= 20.0)
      Predict: 11.0
     Else (feature 0 > 20.0)
      Predict: 4.0E-1
    Else (feature 2 > -0.125)
     If (feature 3 <= 4.5)
      Predict: -2.0
     Else (feature 3 > 4.5)
      Predict: 0.3
  Tree 2 (weight 0.1):
    Predict: 0.7
"""
_trees = TR.parse_trees(_MODEL, ["value", "hour", "relative_diff_lag1", "day"])
add(
    "score_compiled_trees", _KEYS + "prediction@d", lambda s, d: X.calendar_features(X.lag_features(T.readings(s, d), 1)).withColumn("prediction", F.expr(TR.to_sql(_trees))), T.READINGS
    + ", f AS (SELECT sensor_id, date, value, hour(date) AS hour, isodow(date) - 1 AS day, coalesce((value - lag(value) OVER w) / (lag(value) OVER w + 1e-5), -1) AS relative_diff_lag1 FROM readings" + _W + ")",
    f"SELECT sensor_id, date, {TR.to_sql(_trees, chr(34))} AS prediction FROM f",
)
add("score_new_rows", "input_time@t sensor_id prediction_time@t y_pred_delta@d y_pred_total@d", J.new_rows_query)
add("fit_apply_states", _KEYS + "sensor_uid@i is_congested@i is_outlier@i", J.states_query, T.SPLIT + _CONG + ", u AS (SELECT sensor_id, row_number() OVER (ORDER BY sensor_id) - 1 AS uid FROM (SELECT DISTINCT sensor_id FROM split WHERE NOT test_set)), q AS (SELECT quantile_cont(value, 0.01) AS lo, quantile_cont(value, 0.99) AS hi FROM split WHERE NOT test_set)", "SELECT c.sensor_id, c.date, coalesce(uid, -1) AS sensor_uid, is_congested, (value < lo OR value > hi)::int AS is_outlier FROM cong c LEFT JOIN u USING (sensor_id), q WHERE test_set")
add(
    "fit_apply_all_states", _KEYS + "sensor_uid@i sensor_mean@d is_congested@i is_outlier@i target_scaled@d", J.all_states_query,
    T.SPLIT.replace("split AS (", "plain AS (") + ", split AS (SELECT * FROM (SELECT *, lead(value) OVER w - value AS target FROM plain WINDOW w AS (PARTITION BY sensor_id ORDER BY date)) WHERE target IS NOT NULL)" + _CONG
    + ", tr AS (SELECT * FROM split WHERE NOT test_set), u AS (SELECT sensor_id, row_number() OVER (ORDER BY sensor_id) - 1 AS uid, avg(value) AS mean, avg(target) AS lm, sqrt(greatest(var_pop(target), 1e-8)) AS ls FROM tr GROUP BY 1), q AS (SELECT quantile_cont(value, 0.01) AS lo, quantile_cont(value, 0.99) AS hi FROM tr)",
    "SELECT c.sensor_id, c.date, coalesce(uid, -1) AS sensor_uid, coalesce(mean, (SELECT avg(value) FROM tr)) AS sensor_mean, is_congested, (value < lo OR value > hi)::int AS is_outlier, (target - lm) / ls AS target_scaled FROM cong c LEFT JOIN u USING (sensor_id), q WHERE test_set",
)
_DRIFT = T.PREDICTIONS + ", p AS (SELECT * FROM predictions WHERE model = 'drift' AND horizon = 1)"
add("prediction_frame", "input_time@t sensor_id prediction_time@t y_pred_delta@d y_pred_total@d", lambda s, d: P.prediction_frame(_drift(s, d).withColumn("delta", F.col("y_pred") - F.col("value")), "delta", 60), _DRIFT, "SELECT date AS input_time, sensor_id, date + INTERVAL 1 HOUR AS prediction_time, y_pred - value AS y_pred_delta, y_pred - value + value AS y_pred_total FROM p")
add("infer_horizon", "horizon_min@i", lambda s, d: P.infer_horizon(_drift(s, d, 3)), T.PREDICTIONS, "SELECT round(median(epoch(prediction_time - date) / 60)) AS horizon_min FROM predictions WHERE model = 'drift' AND horizon = 3")
add("reconstruct_target", _KEYS + "y_total@d", lambda s, d: P.reconstruct_target(_drift(s, d).withColumn("z", (F.col("y_pred") - F.col("value")) / 2), "z", "value", std=2.0), _DRIFT, "SELECT sensor_id, date, (y_pred - value) / 2 * 2 + value AS y_total FROM p")
add("residual_table", _KEYS + "residual_target@d model_pred@d model_delta@d", lambda s, d: P.residual_table(_drift(s, d)), _DRIFT, "SELECT sensor_id, date, y - y_pred AS residual_target, y_pred AS model_pred, y_pred - value AS model_delta FROM p")
add("residual_correction", _KEYS + "y_corr@d", lambda s, d: P.residual_correction(_drift(s, d).withColumn("r", F.lit(0.3) * (F.col("value") - F.col("y_pred"))), "r", 3.0), _DRIFT, "SELECT sensor_id, date, CASE WHEN abs(0.3 * (value - y_pred)) > 3 THEN y_pred + 0.3 * (value - y_pred) ELSE y_pred END AS y_corr FROM p")
_odd = lambda s, d: T.predictions(s, d).filter("model = 'drift' and horizon = 1").withColumn("y_pred", F.col("y_pred") + F.lit(0.00031415926))  # noqa: E731  no rounding ties
_ODD = T.PREDICTIONS + ", p AS (SELECT sensor_id, date, value, y, y_pred + 0.00031415926 AS y_pred FROM predictions WHERE model = 'drift' AND horizon = 1)"
_NAIVE = ", c1 AS (SELECT * REPLACE (round_even(CASE WHEN abs((y_pred - value) / nullif(value, 0)) > 0.5 THEN value + 0.00001 ELSE y_pred END, 2) AS y_pred) FROM p)"
_oddv = lambda s, d: _odd(s, d).withColumn("value", F.col("value") + F.lit(0.00001))
_ODDV = _ODD.replace("date, value, y,", "date, value + 0.00001 AS value, y,")
_NAIVE = _NAIVE.replace("value + 0.00001 ELSE", "value ELSE")
add("correct_naive", _KEYS + "y_pred@d", lambda s, d: P.correct_naive(_oddv(s, d)), _ODDV + _NAIVE, "SELECT * FROM c1")
add("correct_rolling_median", _KEYS + "y_pred@d", lambda s, d: P.correct_rolling_median(_odd(s, d)), _ODD, "SELECT sensor_id, date, round_even(median(y_pred) OVER (PARTITION BY sensor_id ORDER BY date ROWS 2 PRECEDING), 2) AS y_pred FROM p")
_E3 = ", numbered AS (SELECT *, row_number() OVER (PARTITION BY sensor_id ORDER BY date) AS rn FROM {p}), e AS (SELECT sensor_id, date, rn, y_pred AS m FROM numbered WHERE rn = 1 UNION ALL SELECT n.sensor_id, n.date, n.rn, e.m * 0.5 + 0.5 * n.y_pred FROM e JOIN numbered n ON n.sensor_id = e.sensor_id AND n.rn = e.rn + 1)"
add("correct_ewma", _KEYS + "y_pred@d", lambda s, d: P.correct_ewma(_odd(s, d)), "RECURSIVE " + _ODD + _E3.format(p="p"), "SELECT sensor_id, date, round_even(m, 2) AS y_pred FROM e")
_bounds = lambda s, d: T.readings(s, d).groupBy("sensor_id").agg((F.min("value") + 5.0).alias("min"), (F.max("value") - 5.0).alias("max"))
add("correct_clip", _KEYS + "y_pred@d", lambda s, d: P.correct_clip(_odd(s, d), _bounds(s, d)), _ODD + ", b AS (SELECT sensor_id, min(value) + 5 AS lo, max(value) - 5 AS hi FROM readings GROUP BY 1)", "SELECT sensor_id, date, round_even(greatest(lo, least(hi, y_pred)), 2) AS y_pred FROM p JOIN b USING (sensor_id)")
add(
    "correct_kalman", _KEYS + "y_pred@d", lambda s, d: P.correct_kalman(_odd(s, d), T.readings(s, d).groupBy("sensor_id").agg(F.avg("value").alias("mean"), F.var_pop("value").alias("var"))),
    "RECURSIVE " + _ODD + """, stats AS (SELECT sensor_id, avg(value) AS mean, var_pop(value) AS var FROM readings GROUP BY 1),
    n AS (SELECT p.sensor_id, date, y_pred AS y, mean, var, row_number() OVER (PARTITION BY p.sensor_id ORDER BY date) AS rn, count(*) OVER (PARTITION BY p.sensor_id) AS last FROM p JOIN stats USING (sensor_id)),
    f AS (SELECT sensor_id, date, rn, last, mean + (y - mean) / 2 AS m, var / 2 AS v FROM n WHERE rn = 1 UNION ALL
          SELECT n.sensor_id, n.date, n.rn, n.last, f.m + (f.v + 1) / (f.v + 1 + n.var) * (n.y - f.m), (f.v + 1) * (1 - (f.v + 1) / (f.v + 1 + n.var)) FROM f JOIN n ON n.sensor_id = f.sensor_id AND n.rn = f.rn + 1),
    b AS (SELECT sensor_id, date, rn, m AS s FROM f WHERE rn = last UNION ALL SELECT f.sensor_id, f.date, f.rn, f.m + f.v / (f.v + 1) * (b.s - f.m) FROM b JOIN f ON f.sensor_id = b.sensor_id AND f.rn = b.rn - 1)""",
    "SELECT sensor_id, date, round_even(s, 2) AS y_pred FROM b",
)


def _half_even(x: str) -> str:
    """Rounding to cents by the decimal digits of a double, as Spark does it; DuckDB rounds the binary product, which differs on ties."""
    cents = f"(({x})::varchar::decimal(30, 17) * 100)"
    return f"((floor({cents}) + CASE WHEN {cents} - floor({cents}) > 0.5 OR ({cents} - floor({cents}) = 0.5 AND floor({cents}) % 2 = 1) THEN 1 ELSE 0 END)::double / 100)"


add(
    "correct_all", _KEYS + "y_pred@d", lambda s, d: P.correct_all(_oddv(s, d), _bounds(s, d)),
    "RECURSIVE " + _ODDV + _NAIVE + """, k AS (SELECT *, row_number() OVER w AS rn, lag(y_pred) OVER w AS y1, lag(y_pred, 2) OVER w AS y2 FROM c1 WINDOW w AS (PARTITION BY sensor_id ORDER BY date)),
    c2 AS (SELECT sensor_id, date, rn, CASE rn WHEN 1 THEN y_pred WHEN 2 THEN """ + _half_even("0.5 * least(y1, y_pred) + 0.5 * greatest(y1, y_pred)") + """ ELSE greatest(least(y_pred, y1), least(greatest(y_pred, y1), y2)) END AS y_pred FROM k),
    e AS (SELECT sensor_id, date, rn, y_pred AS m FROM c2 WHERE rn = 1 UNION ALL SELECT n.sensor_id, n.date, n.rn, e.m * 0.5 + 0.5 * n.y_pred FROM e JOIN c2 n ON n.sensor_id = e.sensor_id AND n.rn = e.rn + 1),
    b AS (SELECT sensor_id, min(value) + 5 AS lo, max(value) - 5 AS hi FROM readings GROUP BY 1)""",
    "SELECT sensor_id, date, " + _half_even("greatest(lo, least(hi, " + _half_even("m") + "))") + " AS y_pred FROM e JOIN b USING (sensor_id)",
)

# 2.11 Evaluation
_METRICS = """count(*) AS n, avg(ae) AS mae, median(ae) AS median_ae, sqrt(avg(ae * ae)) AS rmse, avg(ae / greatest(abs(y), 0.01)) * 100 AS mape, avg(CASE WHEN abs(y) + abs(q) = 0 THEN ae ELSE ae / ((abs(y) + abs(q)) / 2) END) * 100 AS smape,
    stddev_pop(ae) AS mae_std, stddev_pop(ae) AS median_ae_std, stddev_pop(ae * ae) AS rmse_std, stddev_pop(ae / greatest(abs(y), 0.01)) * 100 AS mape_std, stddev_pop(CASE WHEN abs(y) + abs(q) = 0 THEN ae ELSE ae / ((abs(y) + abs(q)) / 2) END) * 100 AS smape_std"""
_MSPEC = "n@i mae@d median_ae@d rmse@d mape@d smape@d mae_std@d median_ae_std@d rmse_std@f mape_std@f smape_std@f"
_err = lambda q, where="model = 'drift' AND horizon = 1": f", m AS (SELECT *, {q} AS q, abs(y - {q}) AS ae FROM predictions WHERE {where})"
add("evaluate_model", _MSPEC, lambda s, d: P.evaluate_model(_drift(s, d)), T.PREDICTIONS + _err("y_pred"), f"SELECT {_METRICS} FROM m")
add("evaluate_naive", _MSPEC, lambda s, d: P.evaluate_naive(_drift(s, d)), T.PREDICTIONS + _err("value"), f"SELECT {_METRICS} FROM m")
_zeros = lambda s, d: _drift(s, d).withColumn("y", F.when(F.hour("date") == 3, 0.0).otherwise(F.col("y")))
_ZEROS = T.PREDICTIONS + ", z AS (SELECT * REPLACE (CASE WHEN hour(date) = 3 THEN 0.0 ELSE y END AS y) FROM predictions WHERE model = 'drift' AND horizon = 1)"
add("mape_zero_handling", "mape_discard@d mape_epsilon@d", lambda s, d: P.mape_zero_handling(_zeros(s, d)), _ZEROS, "SELECT avg(abs(y - y_pred) / nullif(abs(y), 0)) * 100 AS mape_discard, avg(abs(y - y_pred) / greatest(abs(y), 0.01)) * 100 AS mape_epsilon FROM z")
add("zero_share", "zero_percent@d", lambda s, d: P.zero_share(_zeros(s, d)), _ZEROS, "SELECT avg((y = 0)::int) * 100 AS zero_percent FROM z")
_SERIES = "avg(abs(y - y_pred)) AS mae, sqrt(avg((y - y_pred) ** 2)) AS rmse, avg(abs(y - y_pred) / nullif(abs(y), 0)) * 100 AS mape, avg(2 * abs(y - y_pred) / (abs(y) + abs(y_pred) + 1e-12)) * 100 AS smape"
add("series_metrics", "mae@d rmse@d mape@d smape@d", lambda s, d: P.series_metrics(_zeros(s, d)), _ZEROS, f"SELECT {_SERIES} FROM z")
add("metrics_by_sensor", "sensor_id mae@d rmse@d mape@d smape@d", lambda s, d: P.metrics_by_sensor(_zeros(s, d)), _ZEROS + f", b AS (SELECT sensor_id, {_SERIES} FROM z GROUP BY 1)", "SELECT * FROM b UNION ALL SELECT 'all', avg(mae), avg(rmse), avg(mape), avg(smape) FROM b")
add("metrics_by_step", "timestep@i mae@d rmse@d mape@d", lambda s, d: P.metrics_by_step(T.step_predictions(s, d)), T.STEPS + ", b AS (SELECT timestep, avg(abs(y - y_pred)) AS mae, sqrt(avg((y - y_pred) ** 2)) AS rmse, avg(abs(y - y_pred) / y) AS mape FROM steps WHERE y <> 0 GROUP BY 1)", "SELECT * FROM b UNION ALL SELECT -1, avg(mae), avg(rmse), avg(mape) FROM b")
add("metrics_plain", "mae@d rmse@d mape@d", lambda s, d: P.metrics_plain(T.step_predictions(s, d)), T.STEPS, "SELECT avg(abs(y - y_pred)) AS mae, sqrt(avg((y - y_pred) ** 2)) AS rmse, avg(abs(y - y_pred) / nullif(y, 0)) AS mape FROM steps")
add("compare_corrections", "variant " + _MSPEC, lambda s, d: P.compare_corrections(_oddv(s, d), P.correct_naive(_oddv(s, d))), _ODDV + _NAIVE + ", m AS (SELECT 'raw' AS variant, y, y_pred AS q, abs(y - y_pred) AS ae FROM p UNION ALL SELECT 'corrected', y, y_pred, abs(y - y_pred) FROM c1)", f"SELECT variant, {_METRICS} FROM m GROUP BY 1")
add("compare_models", "model horizon@i " + _MSPEC, lambda s, d: P.compare_models(T.predictions(s, d)), T.PREDICTIONS + _err("y_pred", "true"), f"SELECT model, horizon, {_METRICS} FROM m GROUP BY 1, 2")
add("metrics_long", "type model metric value@d", lambda s, d: P.metrics_long(P.series_metrics(T.predictions(s, d), ["model"]), "test", ["model"]), T.PREDICTIONS + f", b AS (SELECT model, {_SERIES} FROM predictions GROUP BY 1)", " UNION ALL ".join(f"SELECT 'test' AS type, model, '{m}' AS metric, {m} AS value FROM b" for m in ("mae", "rmse", "mape", "smape")))
add("residual_workflow", "variant " + _MSPEC, lambda s, d: J.residual_workflow(X.calendar_features(_drift(s, d)), ["value", "hour", "day"], max_iter=5))

# 2.12 Streaming
# Rows arrive in three slices, some late, some twice; what the watermark has passed by the slices before is dropped.
_ARRIVE = """, arrivals AS (
        SELECT * FROM (SELECT *, least(2, (day(date) - 1) // 10 + ({n} % 20 = 0)::int) AS slice, {n} AS n FROM {rows})
        UNION ALL SELECT * FROM (SELECT *, least(2, (day(date) - 1) // 10 + ({n} % 20 = 0)::int) AS slice, {n} AS n FROM {rows}) WHERE n % 25 = 1
    ), tops AS (SELECT slice, max(date) AS top FROM arrivals GROUP BY 1), marks AS (SELECT s.slice, max(t.top) AS passed FROM (SELECT unnest([0, 1, 2]) AS slice) s LEFT JOIN tops t ON t.slice < s.slice GROUP BY 1)"""
add(
    "stream_grid", _KEYS + "value@d", ST.grid_query, T.IRREGULAR + _ARRIVE.format(rows="irregular", n="event_id")
    + ", hours AS (SELECT sensor_id, date_trunc('hour', date) AS date, avg(value) AS value FROM arrivals JOIN marks USING (slice) WHERE passed IS NULL OR date_trunc('hour', date) + INTERVAL 1 HOUR > passed - INTERVAL 1 HOUR GROUP BY 1, 2)",
    "SELECT * FROM hours WHERE date + INTERVAL 1 HOUR <= (SELECT max(date) FROM irregular) - INTERVAL 1 HOUR",
)
add("stream_flags", _KEYS + "is_congested@i is_outlier@i", ST.flags_query, T.SPLIT + _CONG + ", q AS (SELECT quantile_cont(value, 0.01) AS lo, quantile_cont(value, 0.99) AS hi FROM split WHERE NOT test_set)", "SELECT sensor_id, date, is_congested, (value < lo OR value > hi)::int AS is_outlier FROM cong, q")
_IN_ORDER = _ARRIVE.format(rows="readings", n="(epoch(date)::bigint // 3600 + sensor_id[2:3]::int)") + """, taken AS (
        SELECT DISTINCT sensor_id, date, value FROM arrivals JOIN marks USING (slice) WHERE passed IS NULL OR date > passed - INTERVAL 1 DAY
    ), s AS (SELECT sensor_id, date, row_number() OVER w AS rn, lag(value) OVER w AS lag1, lag(value, 2) OVER w AS lag2, value + 0.5 * (value - lag(value) OVER w) AS y_pred FROM taken""" + _W + ")"
add("stream_score", _KEYS + "lag1@d lag2@d y_pred@d", ST.score_query, T.READINGS + _IN_ORDER, "SELECT * FROM s WHERE rn > 2 AND date <= (SELECT max(date) FROM readings) - INTERVAL 1 DAY")
add("stream_in_order", _KEYS + "value@d", ST.order_query, T.READINGS + _IN_ORDER, "SELECT * FROM taken WHERE date <= (SELECT max(date) FROM readings) - INTERVAL 1 DAY")
add("stream_scorer", "input_time@t sensor_id prediction_time@t y_pred_total@d", ST.scorer_query)
add("stream_model_score", "input_time@t sensor_id prediction_time@t y_pred_total@d", ST.model_query)

# The same over suppliers as sensors, whose number and length grow with the tables
_LARGE: dict[str, Callable[[DataFrame], DataFrame]] = {
    "smooth_speeds": C.smooth_speeds,
    "lag_features": X.lag_features,
    "create_target": lambda df: X.create_target(df, 3),
    "rolling_slope": X.rolling_slope,
    "rolling_volatility": X.rolling_volatility,
    "rolling_extrema": X.rolling_extrema,
    "rolling_context": X.rolling_context,
    "ewma_mean_slope": X.ewma_mean_slope,
    "seq_windows": lambda df: _hist(P.seq_windows(df, 4, 2), "history"),
    "seq_windows_chunked": lambda df: _hist(P.seq_windows(df, 4, 2, hours=8760), "history"),
    "seq2seq_windows_chunked": lambda df: _hist(_hist(P.seq2seq_windows(df, 3, 2, hours=8760), "x"), "y"),
}


def _on_large(name: str, op: Callable[[DataFrame], DataFrame]) -> None:
    QUERIES[f"{name}_large"] = lambda spark, sf_dir: _shown(op(T.readings_large(spark, sf_dir)), SPECS[name])
    ORACLE_SQL[f"{name}_large"] = ORACLE_SQL[name].replace(T.READINGS, T.READINGS_LARGE)


for _name, _op in _LARGE.items():
    _on_large(_name, _op)
