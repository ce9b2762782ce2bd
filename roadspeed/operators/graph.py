"""Neighbour lookups, upstream travel times, previous-weekday history and side tables.

An edge table has sensor_id, direction ('down' or 'up'), k, neighbor_id, distance in metres. It grows with the road graph,
not with the readings; Spark broadcasts it only while it is under its own size limit.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .base import COLS, Cols, minutes
from .features import median_of, numbered, slope


def _seen(df: DataFrame, viewers: DataFrame, value: Column, n_slots: int, show: dict[str, Callable[[Column, Column], Column]], cols: Cols) -> DataFrame:
    """``df`` with an array ``_seen_{x}`` for each measure x: what the series that a sensor looks at hold at the row's date, by slot.

    ``viewers``: _provider, _target, _slot and more columns: who looks at a provider, at which slot. A provider's row becomes its own row and a cell
    for each of its viewers; both are dealt by (sensor, date) in one exchange, and meet there. No table is joined with itself, and a
    long sensor is not one task's work. ``show`` makes a measure of the provider's value and its viewer.
    """
    sensor, date = F.col(cols.sensor), F.col(cols.date)
    kinds = viewers.select("_provider", F.struct("_target", "_slot", *[c for c in viewers.columns if c not in ("_provider", "_target", "_slot")]).alias("_v"))
    by_provider = kinds.groupBy("_provider").agg(F.collect_list("_v").alias("_viewers"))  # as many as look at one sensor
    met = df.withColumn("_value", value).join(by_provider, sensor == F.col("_provider"), "left")
    measures = lambda v: [f(F.col("_value"), v).alias(x) for x, f in show.items()]
    cell = F.transform("_viewers", lambda v: F.struct(v["_target"].alias("key"), F.lit(None).cast(df.schema).alias("own"), v["_slot"].alias("slot"), F.struct(*measures(v)).alias("m")))
    own = F.array(F.struct(sensor.alias("key"), F.struct(*df.columns).alias("own")))
    cells = met.select(date.alias("_date"), own.alias("_own"), F.when(date.isNotNull(), cell).alias("_cells"))
    blank = cells.schema["_cells"].dataType.elementType
    mine = F.transform("_own", lambda o: F.struct(o["key"].alias("key"), o["own"].alias("own"), F.lit(None).cast(blank["slot"].dataType).alias("slot"), F.lit(None).cast(blank["m"].dataType).alias("m")))
    rows = cells.select("_date", F.explode(F.concat(mine, F.coalesce("_cells", F.array().cast(cells.schema["_cells"].dataType)))).alias("_r")).select("_date", "_r.*")
    at = Window.partitionBy("key", "_date")
    slots = {f"_seen_{x}": F.array(*[F.max(F.when(F.col("slot") == i, F.col(f"m.{x}"))).over(at) for i in range(n_slots)]) for x in show}
    return rows.withColumns(slots).filter("own is not null").select("own.*", *slots)


def _adjacent(df: DataFrame, edges: DataFrame, column: str, n: int, make, fill: float | None, suffix: str, cols: Cols) -> DataFrame:
    slots = [(d, k) for d in ("down", "up") for k in range(1, n + 1)]
    slot = F.col("k") - 1 + F.when(F.col("direction") == "up", n).otherwise(0)
    known = edges.filter(F.col("neighbor_id").isNotNull() & F.col("sensor_id").isNotNull() & F.col("k").between(1, n) & F.col("direction").isin("down", "up"))
    viewers = known.select(F.col("neighbor_id").alias("_provider"), F.col("sensor_id").alias("_target"), slot.alias("_slot"), F.col("distance").alias("_distance"))
    out = _seen(df, viewers, F.col(column), len(slots), {"nb": lambda value, _: value, "distance": lambda _, v: v["_distance"]}, cols)
    new = {f"{d}stream_sensor_{suffix}{k}": make(d, F.col("_seen_nb")[i], F.col("_seen_distance")[i]) for i, (d, k) in enumerate(slots)}
    if fill is not None:
        new = {c: F.coalesce(v, F.lit(fill)) for c, v in new.items()}
    return out.withColumns(new).drop("_seen_nb", "_seen_distance")


def adjacent_values(df: DataFrame, edges: DataFrame, n: int = 1, relative: bool = False, by_distance: bool = False, epsilon: float = 1e-5, fill: float | None = -1.0, cols: Cols = COLS) -> DataFrame:
    """Value of the k-th neighbour down and up the road at the same time, plain or as a relative difference, or per metre."""

    def make(direction: str, nb: Column, distance: Column) -> Column:
        v = F.col(cols.value)
        x = nb if not relative else F.try_divide(v - nb, nb + F.lit(epsilon)) if direction == "up" else F.try_divide(nb - v, v + F.lit(epsilon))
        return F.try_divide(x / F.lit(3.6), distance) if by_distance else x

    return _adjacent(df, edges, cols.value, n, make, fill, "", cols)


def adjacent_congestion(df: DataFrame, edges: DataFrame, n: int = 1, by_distance: bool = False, epsilon: float = 1e-5, fill: float | None = None, cols: Cols = COLS) -> DataFrame:
    """The same for the flag is_congested, if asked divided by the distance in km."""
    make = lambda _, nb, distance: nb / (distance / F.lit(1000.0) + F.lit(epsilon)) if by_distance else nb.cast("double")
    return _adjacent(df, edges, "is_congested", n, make, fill, "congested_", cols)


def missing_neighbors(df: DataFrame, edges: DataFrame, cols: Cols = COLS) -> DataFrame:
    """Sensors that are absent from either neighbour dictionary."""
    sensors = df.select(cols.sensor).distinct()
    both = edges.groupBy(F.col("sensor_id").alias(cols.sensor)).agg(F.countDistinct("direction").alias("d")).filter("d = 2")
    return sensors.join(both, cols.sensor, "left_anti")


def upstream_travel_time(
    df: DataFrame, edges: DataFrame, quantile: float = 0.95, fallback: float = 100.0, cap_minutes: float = 30.0, minutes_per_row: int = 1, as_km: bool = False, train_only: bool = False, cols: Cols = COLS
) -> DataFrame:
    """sensor_id, k, upstream, free_flow, tau: rows that traffic takes from the k-th upstream sensor at its free-flow speed."""
    rows = df.filter(~F.col(cols.test)) if train_only else df
    flow = rows.groupBy(F.col(cols.sensor).alias("upstream")).agg(F.percentile(cols.value, quantile).alias("_flow"))
    up = edges.filter("direction = 'up' and neighbor_id is not null").select("sensor_id", "k", F.col("neighbor_id").alias("upstream"), "distance")
    out = up.join(flow, "upstream", "left").withColumn("free_flow", F.when(F.col("_flow") > 0, F.col("_flow")).otherwise(F.lit(fallback)))
    km = F.col("distance") if as_km else F.col("distance") / F.lit(1000.0)
    travel = F.greatest(F.lit(0.0), F.least(km / (F.col("free_flow") / 60), F.lit(cap_minutes)))
    return out.select("sensor_id", "k", "upstream", "free_flow", F.greatest(F.lit(1), F.bround(travel / minutes_per_row, 0).cast("int")).alias("tau"))


def upstream_shifted(df: DataFrame, taus: DataFrame, slopes: tuple[int, ...] = (3, 5), n: int = 1, fill: float = -1.0, cols: Cols = COLS) -> DataFrame:
    """Upstream speed, its first difference and rolling slopes, each tau rows earlier in the upstream series, at the same timestamp.

    The shifts are lags in the window of the upstream series, one for each different tau; these are whole numbers of rows up to the cap
    of the travel times, so their list is short.
    """
    s = cols.series()
    pairs = taus.filter(F.col("k").between(1, n) & F.col("sensor_id").isNotNull() & F.col("upstream").isNotNull())
    shifts = sorted(r[0] for r in pairs.select("tau").distinct().collect())
    names = ["speed", "delta1", *[f"slope_w{w}" for w in slopes]]
    held = numbered(df, cols, "_row").withColumn("_now", F.struct(F.col(cols.value).alias("speed"), (F.col(cols.value) - F.lag(cols.value).over(s)).alias("delta1"), *[slope(w, cols).alias(f"slope_w{w}") for w in slopes]))
    held = held.withColumn("_shifts", F.array(*[F.lag("_now", t).over(s) for t in shifts] or [F.col("_now")])).drop("_row", "_now")
    at = F.array_position(F.array(*[F.lit(t) for t in shifts] or [F.lit(0)]), F.col("tau").cast("int"))
    viewers = pairs.select(F.col("upstream").alias("_provider"), F.col("sensor_id").alias("_target"), (F.col("k") - 1).alias("_slot"), at.cast("int").alias("_at"))
    show = {x: lambda value, v, x=x: F.try_element_at(value, v["_at"])[x] for x in names}
    out = _seen(held, viewers, F.col("_shifts"), n, show, cols).drop("_shifts")
    new = {f"up{k}_shift_{x}": F.coalesce(F.col(f"_seen_{x}")[k - 1], F.lit(fill)) for k in range(1, n + 1) for x in names}
    return out.withColumns(new).drop(*[f"_seen_{x}" for x in names])


# Previous weekday
def _at(what: str, min_ahead: int, cols: Cols) -> Column:
    """The largest value of an expression at exactly so many minutes from the row's date, in the same sensor: a frame of one moment in the window of the sensor."""
    bound = f"INTERVAL '{abs(min_ahead)}' MINUTE {'PRECEDING' if min_ahead < 0 else 'FOLLOWING'}" if min_ahead else "CURRENT ROW"
    return F.expr(f"max({what}) OVER (PARTITION BY `{cols.sensor}` ORDER BY `{cols.date}` RANGE BETWEEN {bound} AND {bound})")


def _lookups(df: DataFrame, horizon_min: int, offsets: list[int], cols: Cols) -> tuple[DataFrame, Column, Column, dict[int, Column]]:
    """``df`` with helper columns; whether a row looks at the day before in place of its own day; its days back; the values around its lookup time by offset.

    Mondays look three days back, Saturdays and Sundays seven, other days one; Sundays without a value there look one day back.
    """
    days, value = (1, 3, 7), f"`{cols.value}`"
    cells = {f"_at{d}_{o}": _at(value, horizon_min + o - 1440 * d, cols) for d in days for o in sorted({0, *offsets})}
    out = df.withColumns(cells)
    day = F.weekday(cols.date)
    instead = (day == 6) & F.col("_at7_0").isNull()
    back = F.when(day == 0, 3).when((day >= 5) & ~instead, 7).otherwise(1)
    pick = lambda o: F.when(F.col("_back") == 3, F.col(f"`_at3_{o}`")).when(F.col("_back") == 7, F.col(f"`_at7_{o}`")).otherwise(F.col(f"`_at1_{o}`"))
    return out.withColumn("_back", back), instead, F.col("_back"), {o: F.when(F.col(cols.date).isNotNull(), pick(o)) for o in offsets}


def with_lookup(df: DataFrame, horizon_min: int, cols: Cols = COLS) -> DataFrame:
    """Adds lookup_time: the previous weekday; on Sundays without a value there, the day before."""
    out, _, back, _ = _lookups(df, horizon_min, [], cols)
    return out.withColumn("lookup_time", F.col(cols.date) + minutes(horizon_min) - F.make_dt_interval(days=back)).select(*df.columns, "lookup_time")


def previous_weekday_window(df: DataFrame, horizon_min: int, before: int = 60, after: int = 60, step: int = 60, fill: float | None = None, cols: Cols = COLS) -> DataFrame:
    """prev_wd_val_t{offset}: raw values at the lookup time plus each offset in minutes."""
    out, _, _, values = _lookups(df, horizon_min, list(range(-before, after + 1, step)), cols)
    names = {f"prev_wd_val_t{o}": v for o, v in values.items()}
    out = out.withColumns(names).select(*[c for c in df.columns if c not in names], *names)
    return out if fill is None else out.fillna(fill, list(names))


_STATS = {"mean": F.avg, "min": F.min, "max": F.max, "std": F.stddev_samp, "median": lambda c: F.percentile(c, 0.5)}


def _mean_of(values: Column) -> Column:
    return F.try_divide(F.aggregate(values, F.lit(0.0), lambda a, x: a + x), F.size(values))


def _std_of(values: Column) -> Column:
    squares = F.aggregate(F.transform(values, lambda x: (x - _mean_of(values)) * (x - _mean_of(values))), F.lit(0.0), lambda a, x: a + x)
    return F.when(F.size(values) > 1, F.sqrt(squares / (F.size(values) - 1)))


_ARRAY_STATS = {"mean": _mean_of, "min": F.array_min, "max": F.array_max, "std": _std_of, "median": median_of}


def previous_weekday_local_agg(df: DataFrame, horizon_min: int, before: int = 60, after: int = 60, step: int = 60, aggs: tuple[str, ...] = tuple(_STATS), cols: Cols = COLS) -> DataFrame:
    """{agg}_local over the row's window, nulls left out."""
    out, _, _, values = _lookups(df, horizon_min, list(range(-before, after + 1, step)), cols)
    out = out.withColumn("_near", F.array_compact(F.array(*[v.cast("double") for v in values.values()])))
    names = {f"{a}_local": _ARRAY_STATS[a](F.col("_near")) for a in aggs}
    return out.withColumns(names).select(*[c for c in df.columns if c not in names], *names)


def previous_weekday_climatology(df: DataFrame, horizon_min: int, before: int = 0, after: int = 0, aggs: tuple[str, ...] = ("mean", "median"), train_only: bool = False, cols: Cols = COLS) -> DataFrame:
    """prev_wd_{agg}_{before}_{after}: statistics of all rows of the sensor at the lookup time's HH:MM, where that time is a timestamp of some sensor."""
    clock = lambda c: F.date_format(c, "HH:mm")
    rows = df.filter(~F.col(cols.test)) if train_only else df
    stats = rows.groupBy(F.col(cols.sensor).alias("_s"), clock(cols.date).alias("_hm")).agg(*[_STATS[a](cols.value).alias(f"prev_wd_{a}_{before}_{after}") for a in aggs])
    there = df.select(F.col(cols.date).alias("lookup_time")).distinct()
    base = with_lookup(df, horizon_min, cols)
    keyed = base.join(there.withColumn("_there", F.lit(True)), "lookup_time", "left").withColumn("_k", F.when(F.col("_there"), clock("lookup_time")))
    return keyed.join(stats, (F.col(cols.sensor) == F.col("_s")) & (F.col("_k") == F.col("_hm")), "left").drop("_s", "_hm", "_k", "_there", "lookup_time")


def previous_weekday_value(df: DataFrame, horizon_min: int, strict: bool = False, cols: Cols = COLS) -> DataFrame:
    """prev_weekday_value: the value at the previous working day (Saturday, Sunday and Monday look at Friday) plus the horizon; ``strict``: on working days only."""
    day = F.weekday(cols.date)
    by_days = {d: f"_back{d}" for d in (1, 2, 3)}
    out = df.withColumns({name: _at(f"`{cols.value}`", horizon_min - 1440 * d, cols) for d, name in by_days.items()})
    found = F.when(day == 0, F.col(by_days[3])).when(day == 6, F.col(by_days[2])).when(day.isNotNull(), F.col(by_days[1]))
    return out.withColumn("prev_weekday_value", F.when(day < 5, found) if strict else found).drop(*by_days.values())


# Side tables
def merge_external_predictions(df: DataFrame, external: DataFrame, drop_missing: bool = False, as_delta: bool = False, name: str = "gman_prediction", cols: Cols = COLS) -> DataFrame:
    """Join predictions by (issue date, sensor), trimmed to the time frame of the readings; ``as_delta`` keeps the total as {name}_orig."""
    frame = df.agg(F.min(cols.date).alias("lo"), F.max(cols.date).alias("hi"))  # one row
    side = external.withColumnRenamed(f"{name}_date", cols.date).join(F.broadcast(frame), F.col(cols.date).between(F.col("lo"), F.col("hi"))).drop("lo", "hi")
    out = df.join(side, [cols.sensor, cols.date], "inner" if drop_missing else "left")
    if drop_missing:
        out = out.filter(F.col(name).isNotNull())
    return out.withColumn(f"{name}_orig", F.col(name)).withColumn(name, F.col(name) - F.col(cols.value)) if as_delta else out


def merge_horizon_predictions(predictions: DataFrame, horizons: list[int], cols: Cols = COLS) -> DataFrame:
    """One row for each (date, sensor) with y_pred_{h} for every horizon and the truth of the smallest: a union pivoted by horizon in one shuffle, not a chain of full joins."""
    at = lambda h, c: F.max(F.when(F.col("horizon") == h, F.col(c)))
    return predictions.groupBy(cols.date, cols.sensor).agg(at(min(horizons), "y").alias("y"), *[at(h, "y_pred").alias(f"y_pred_{h}") for h in horizons])


def attach_actuals(predictions: DataFrame, actuals: DataFrame, value: str, cols: Cols = COLS) -> DataFrame:
    """y_act_total by (prediction_time, sensor). Keys of the actuals must be unique; see ``clean.duplicate_keys``."""
    side = actuals.select(F.col(cols.sensor), F.col(cols.date).alias("prediction_time"), F.col(value).alias("y_act_total"))
    return predictions.join(side, [cols.sensor, "prediction_time"], "left")


def prediction_parity(a: DataFrame, b: DataFrame, column: str = "y_pred_total", cols: Cols = COLS) -> DataFrame:
    """n_common, mean_abs_diff, max_abs_diff over the common (prediction_time, sensor)."""
    side = b.select(cols.sensor, "prediction_time", F.col(column).alias("_b"))
    gap = F.abs(F.col(column) - F.col("_b"))
    return a.join(side, [cols.sensor, "prediction_time"]).agg(F.count("*").alias("n_common"), F.avg(gap).alias("mean_abs_diff"), F.max(gap).alias("max_abs_diff"))
