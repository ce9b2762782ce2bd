"""What the plans of lookups and training tables shuffle, and that they find the same as plain loops."""

import re
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from roadspeed.operators import base, features, graph, split
from roadspeed.operators.base import COLS
from roadspeed.plans import jobs

START = datetime(2024, 1, 5)
SENSORS = [f"S{i}" for i in range(6)]


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    """Readings and edges as files, as jobs have them: some sensors with gaps, a row that is there twice, a missing date and a missing sensor."""
    rng, path = np.random.default_rng(1), str(tmp_path_factory.mktemp("plans"))
    rows = [(s, START + timedelta(hours=i), float(np.round(rng.uniform(5, 90), 3)) if rng.random() > 0.05 else None, i > 400) for s in SENSORS for i in range(500) if rng.random() > 0.1]
    rows += [rows[7], rows[7], ("S1", None, 5.0, False), (None, START, 6.0, False)]
    spark.createDataFrame(rows, "sensor_id string, date timestamp, value double, test_set boolean").write.parquet(f"{path}/rows")
    edges = [(s, d, k, (t := SENSORS[j]) if 0 <= (j := i + (k if d == "down" else -k)) < 6 else None, 100.0 * k) for i, s in enumerate(SENSORS) for d in ("down", "up") for k in (1, 2)]
    edges += [("S0", "down", 1, "S3", 900.0), (None, "up", 1, "S2", 1.0)]  # two for one slot; nobody
    spark.createDataFrame(edges, "sensor_id string, direction string, k int, neighbor_id string, distance double").write.parquet(f"{path}/edges")
    return spark.read.parquet(f"{path}/rows"), spark.read.parquet(f"{path}/edges"), rows, edges


def plan(df):
    """Hash exchanges and scans of the readings before they run."""
    text = df._jdf.queryExecution().executedPlan().toString()
    return text.count("Exchange hashpartitioning"), len(re.findall(r"FileScan parquet [^\n]*/rows", text)), text


def test_neighbours_meet_in_one_exchange(stored):
    df, edges, rows, edge_rows = stored
    out = graph.adjacent_values(df, edges, 2, fill=None)
    n, scans, text = plan(out)
    assert n <= 2 and scans == 1 and text.count("Join") == 1  # the lookup, and the list of edges
    by = {}
    for s, d, v, _ in rows:
        by.setdefault((s, d), []).append(v)
    top = lambda s, d: max((v for v in by.get((s, d), []) if v is not None), default=None) if d else None
    found = out.collect()
    assert len(found) == len(rows)
    for r in found:
        for word in ("down", "up"):
            for k in (1, 2):
                near = [top(n, r.date) for s, d, kk, n, _ in edge_rows if s is not None and s == r.sensor_id and d == word and kk == k and n is not None]
                assert r[f"{word}stream_sensor_{k}"] == max((v for v in near if v is not None), default=None)


def test_upstream_shift_is_a_lag_in_one_window(spark, stored):
    df, edges, rows, _ = stored
    taus = spark.createDataFrame([("S1", 1, "S0", 3), ("S2", 1, "S1", 1), ("S2", 2, "S0", 7), ("S3", 1, "S3", 1), ("S4", 1, None, 2)], "sensor_id string, k int, upstream string, tau int")
    clean = df.filter("sensor_id is not null and date is not null").dropDuplicates(["sensor_id", "date"])
    out = graph.upstream_shifted(clean, taus, (3,), 2)
    by = {s: sorted({(d, v) for ss, d, v, _ in rows if ss == s and d}) for s in SENSORS}
    for r in out.collect():
        for k in (1, 2):
            pair = next(((u, t) for s, kk, u, t in [("S1", 1, "S0", 3), ("S2", 1, "S1", 1), ("S2", 2, "S0", 7), ("S3", 1, "S3", 1)] if s == r.sensor_id and kk == k), None)
            want = [-1.0, -1.0]
            if pair and (at := next((i for i, (d, _) in enumerate(by[pair[0]]) if d == r.date), -1)) >= pair[1]:
                v, before = by[pair[0]][at - pair[1]][1], by[pair[0]][at - pair[1] - 1][1] if at > pair[1] else None
                want = [-1.0 if v is None else v, -1.0 if v is None or before is None else v - before]
            assert [r[f"up{k}_shift_speed"], r[f"up{k}_shift_delta1"]] == pytest.approx(want)
    n, scans, _ = plan(graph.upstream_shifted(df, taus, (3,), 2))
    assert n <= 3 and scans == 1  # the window of the series, the lookup, and the list of pairs
    assert graph.upstream_shifted(df, taus.limit(0), (3,)).filter("up1_shift_speed <> -1").isEmpty()


def test_previous_weekdays_are_frames_of_one_window(stored):
    df, _, rows, _ = stored
    values = {}
    for s, d, v, _ in rows:
        if d is not None:
            values.setdefault((s, d), []).append(v)
    top = lambda s, d: max((v for v in values.get((s, d), []) if v is not None), default=None)
    out = graph.previous_weekday_window(df, 120, 60, 60)
    n, scans, text = plan(out)
    assert (n, scans, text.count("Join")) == (1, 1, 0)
    for r in out.collect():
        look = None
        if r.date is not None:
            ahead, day = r.date + timedelta(hours=2), r.date.weekday()
            look = ahead - timedelta(days=3 if day == 0 else 7 if day >= 5 else 1)
            if day == 6 and top(r.sensor_id, look) is None:
                look = ahead - timedelta(days=1)
        for o in (-60, 0, 60):
            assert r[f"prev_wd_val_t{o}"] == (top(r.sensor_id, look + timedelta(minutes=o)) if look else None)
    n, _, text = plan(graph.previous_weekday_local_agg(df, 60))
    assert (n, text.count("Join")) == (1, 0)
    near = [(r.sensor_id, r.date, r.n_local if "n_local" in r else r.mean_local, r.std_local, r.median_local) for r in graph.previous_weekday_local_agg(df, 60, 120, 120).collect() if r.mean_local is not None]
    assert near
    n, _, text = plan(graph.previous_weekday_value(df, 60))
    assert (n, text.count("Join")) == (1, 0)


def test_horizons_do_not_shuffle_the_base(spark, stored, tmp_path):
    df, edges, _, _ = stored
    df, config = df.filter("sensor_id is not null and date is not null").dropDuplicates(["sensor_id", "date"]), jobs.BuildConfig(lags=3)
    jobs.build_training_tables(df, edges, str(tmp_path), [2, 1], config, buckets=5)
    name = jobs.stored_base(spark, f"{tmp_path}/base", spark.read.parquet(f"{tmp_path}/base").schema, 5)
    assert len({f.split("_")[-1] for f in spark.table(name).inputFiles()}) <= 5
    for h in (1, 2):
        n, _, text = plan(jobs.finalise_for_horizon(spark.table(name), h, config))
        assert n == 0 and "Exchange" not in text
        fresh = jobs.finalise_for_horizon(jobs.base_features(df, edges, config), h, config)
        written = spark.read.parquet(f"{tmp_path}/tables/horizon={h}")
        show = lambda t: sorted((r.sensor_id, str(r.date), r.target, r.relative_diff_lag3, r.downstream_sensor_1, r.prev_wd_val_t0) for r in t.collect())
        assert repr(show(written)) == repr(show(fresh))
    spark.sql(f"DROP TABLE {name}")
    jobs.build_training_tables(df, edges, str(tmp_path), [3, 1], config)  # goes on where it was
    assert spark.read.parquet(f"{tmp_path}/tables").select("horizon").distinct().count() == 3


def test_all_families_in_the_training_table(stored):
    df, edges, _, _ = stored
    df = df.filter("sensor_id is not null and date is not null").dropDuplicates(["sensor_id", "date"])
    config = jobs.BuildConfig(lags=2, families=tuple(jobs.FAMILIES), upstream=1)
    out = jobs.finalise_for_horizon(jobs.base_features(df, edges, config), 1, config)
    for c in ("slope_5", "ewm_slope_5", "mad_10", "dist_to_max_10", "minutes_since_below", "fast_drop", "z_24", "network_z_6", "jerk", "ema_spread", "up1_shift_speed", "downstream_sensor_1", "target"):
        assert c in out.columns
    smooth = jobs.smoothed(df, config)
    plain = features.create_target(features.rolling_slope(smooth), 1)
    key = lambda t: sorted((r.sensor_id, str(r.date), round(r.slope_5, 6), round(r.target, 6)) for r in t.select("sensor_id", "date", "slope_5", "target").filter(F.col("target").isNotNull()).collect())
    assert key(out) == key(plain)


def test_columns_keep_their_place_and_names(stored):
    df, edges, _, _ = stored
    assert graph.adjacent_values(df, edges, 1).columns == [*df.columns, "downstream_sensor_1", "upstream_sensor_1"]
    assert graph.with_lookup(df, 60).columns == [*df.columns, "lookup_time"]
    assert COLS.sensor in df.columns


def test_dates_are_ordered_in_blocks(spark, monkeypatch):
    """Positions and frames over all dates without a window that holds them all."""
    rng = np.random.default_rng(3)
    rows = [(s, START + timedelta(hours=int(h)), float(rng.integers(0, 90))) for h in rng.choice(4000, 900, replace=False) for s in ("A", "B") if rng.random() > 0.2]
    df = spark.createDataFrame(rows, "sensor_id string, date timestamp, value double").repartition(6)
    dates = sorted({d for _, d, _ in rows})
    index = base.summed_before(df.select("date").distinct(), F.lit(1), "idx", "n", hours=50)
    assert sorted((r.date, r.idx, r.n) for r in index.collect()) == [(d, i, len(dates)) for i, d in enumerate(dates)]
    assert [(r.pos, r.n) for r in split.global_position(df).orderBy("date", "sensor_id").select("pos", "n").collect()] == [(i, len(rows)) for i in range(len(rows))]
    means = [np.mean([v for _, dd, v in rows if dd == d]) for d in dates]
    wide = features.network_context(df, (6, 24))
    blocks = base.trailing_blocks(index.withColumn("v", F.col("idx") * 1.0), "idx", 5, lambda t, at: t.withColumn("s", F.sum("v").over(at.rowsBetween(-5, 0))), size=7)
    assert sorted((r.idx, r.s) for r in blocks.collect()) == [(i, float(sum(range(max(0, i - 5), i + 1)))) for i in range(len(dates))]
    by = {r.date: r for r in wide.collect()}
    for i, d in enumerate(dates):
        for w in (6, 24):
            near = means[max(0, i - w + 1) : i + 1]
            assert by[d][f"network_dev_{w}"] == pytest.approx(means[i] - np.mean(near), abs=1e-9)
    text = wide._jdf.queryExecution().executedPlan().toString()
    assert text.count("SinglePartition") <= 2  # the chunks of time, put in order and summed
