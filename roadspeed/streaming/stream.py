"""Structured Streaming: grid means with a watermark, flags from stored states, scoring with state for each sensor."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from dataclasses import replace
from datetime import datetime

import pandas as pd
from pyspark.ml import PipelineModel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import DataStreamWriter
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, StatefulProcessor, StatefulProcessorHandle, TimerValues

from ..operators import features, predict
from ..operators.base import COLS, Cols, minutes
from ..plans import jobs
from ..sources import tables


def stream_grid(readings: DataFrame, step: str = "1 hour", late: str = "1 hour", cols: Cols = COLS) -> DataFrame:
    """Mean by sensor and step; a step is given out once the watermark has passed it, later rows are dropped."""
    stamped = readings.withWatermark(cols.date, late)
    grid = stamped.groupBy(cols.sensor, F.window(cols.date, step).alias("_w")).agg(F.avg(cols.value).alias(cols.value))
    return grid.select(cols.sensor, F.col("_w.start").alias(cols.date), cols.value)


def stream_flags(readings: DataFrame, states: dict[str, DataFrame], cols: Cols = COLS) -> DataFrame:
    """is_congested and is_outlier of arriving rows: stream-static joins with the stored thresholds."""
    return jobs.apply_states(readings, states, cols)


_WAITING = T.StructType().add("date", T.TimestampType()).add("value", T.DoubleType())
_HELD = T.StructType().add("before", T.ArrayType(T.DoubleType())).add("last_ms", T.LongType())


class _InOrder(StatefulProcessor):
    """Rows of a sensor wait until the watermark has passed them; then they are given out in order of time, with the ``lags`` values before each.

    State: the rows that wait, as one list; the last values and their date. A timer is set for the first row that waits, and one for
    the end of the silence after which a sensor begins anew. Timers fire after all rows of a batch, so no row overtakes another.
    """

    def __init__(self, lags: int, silence_ms: int, names: list[str]):
        self.lags, self.silence_ms, self.names = lags, silence_ms, names

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", _WAITING)
        self.held = handle.getValueState("held", _HELD)

    def _rows(self) -> list[tuple]:
        return list(self.waiting.get()) if self.waiting.exists() else []

    @staticmethod
    def _ms(date: datetime) -> int:
        """Milliseconds, rounded up: a timer for them fires once the watermark has passed the date."""
        return -(-round(pd.Timestamp(date).tz_localize("UTC").value // 1000) // 1000)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        there = {date: value for date, value in self._rows()}
        for pdf in rows:
            for date, value in zip((d.to_pydatetime() for d in pdf[self.names[1]]), pdf[self.names[2]].tolist(), strict=True):
                there.setdefault(date, None if value is None or value != value else float(value))  # of repeated rows the first counts
        if there:
            self.waiting.put(list(there.items()))
            self.handle.registerTimer(self._ms(min(there)))
        yield pd.DataFrame(columns=self.names)

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        now, rows = timerValues.getCurrentWatermarkInMs(), sorted(self._rows(), key=lambda r: r[0])
        due = [r for r in rows if self._ms(r[0]) <= now]
        before, last = (list(self.held.get()[0]), self.held.get()[1]) if self.held.exists() else ([], None)
        out = []
        for date, value in due:
            if last is not None and self._ms(date) - last > self.silence_ms:
                before = []
            if len(before) == self.lags:
                out.append((key[0], date, value, *before))
            before, last = [value, *before][: self.lags], self._ms(date)
        if due:
            self.held.update((before, last))
            self.handle.registerTimer(last + self.silence_ms + 1)
            left = rows[len(due) :]
            if left:
                self.waiting.put(left)
                self.handle.registerTimer(self._ms(left[0][0]))
            else:
                self.waiting.clear()
        elif not rows and last is not None and last + self.silence_ms < now:
            self.held.clear()
        yield pd.DataFrame(out, columns=self.names)

    def close(self) -> None:
        pass


def stream_lags(readings: DataFrame, lags: int = 2, late: str = "1 day", expire: str = "30 days", cols: Cols = COLS) -> DataFrame:
    """sensor, date, value, lag1.. of arriving rows, once a sensor has ``lags`` earlier rows: what ``lag_table`` gives for all rows that come in time.

    A row is given out once the watermark (``late`` behind the newest row) has passed it, so rows may arrive in any order within that time; rows that the
    watermark has passed already are dropped. A sensor that has been silent for ``expire`` of event time begins anew. Needs the state store that ``with_state`` sets.
    """
    names = [f"lag{i}" for i in range(1, lags + 1)]
    schema = f"{cols.sensor} string, {cols.date} timestamp, {cols.value} double" + "".join(f", {n} double" for n in names)
    processor = _InOrder(lags, int(pd.Timedelta(expire).total_seconds() * 1000), [cols.sensor, cols.date, cols.value, *names])
    rows = readings.select(cols.sensor, cols.date, F.col(cols.value).cast("double").alias(cols.value)).filter(F.col(cols.date).isNotNull()).withWatermark(cols.date, late)
    return rows.groupBy(cols.sensor).transformWithStateInPandas(processor, schema, "Append", "EventTime")


def stream_in_order(readings: DataFrame, late: str = "1 day", cols: Cols = COLS) -> DataFrame:
    """The rows alone: each key once, in order of time from batch to batch."""
    return stream_lags(readings, 0, late, cols=cols)


def stream_score(readings: DataFrame, lags: int = 2, drift: float = 0.5, cols: Cols = COLS) -> DataFrame:
    """Those, and y_pred of a drift model."""
    return stream_lags(readings, lags, cols=cols).withColumn("y_pred", F.col(cols.value) + F.lit(drift) * (F.col(cols.value) - F.col("lag1")))


def lag_table(df: DataFrame, lags: int, horizon: int | None = None, cols: Cols = COLS) -> DataFrame:
    """The rows of ``stream_lags`` from a table, with the target if a horizon is given: what a streaming model is fitted on."""
    s = cols.series()
    out = df.select(cols.sensor, cols.date, cols.value).withColumns({f"lag{i}": F.lag(cols.value, i).over(s) for i in range(1, lags + 1)} | {"_n": F.row_number().over(s)})
    out = out if horizon is None else out.withColumn("target", F.lead(cols.value, horizon).over(s) - F.col(cols.value)).filter("target is not null")
    return out.filter(F.col("_n") > lags).drop("_n")


def model_features(df: DataFrame, lags: int, cols: Cols = COLS) -> DataFrame:
    """Features by row alone, on tables and streams: relative differences and the calendar."""
    value = F.col(cols.value)
    relative = {f"relative_diff_lag{i}": (value - F.col(f"lag{i}")) / (F.col(f"lag{i}") + F.lit(1e-5)) for i in range(1, lags + 1)}
    return features.calendar_features(df.withColumns(relative), cols)


def fit_stream_model(train: DataFrame, path: str, lags: int = 2, horizon: int = 1, cols: Cols = COLS) -> None:
    """Fit the tree model on the features that a stream can have, and store it."""
    table = model_features(lag_table(train, lags, horizon, cols), lags, cols)
    jobs.fit_tree_model(table, model_names(lags, cols), max_iter=5).write().overwrite().save(path)


def model_names(lags: int, cols: Cols = COLS) -> list[str]:
    return [cols.value, "hour", "day", *[f"relative_diff_lag{i}" for i in range(1, lags + 1)]]


def stream_model_score(readings: DataFrame, model: PipelineModel, lags: int = 2, horizon_min: int = 60, cols: Cols = COLS) -> DataFrame:
    """Prediction frame of arriving rows by a stored model: lags from the state of their sensor, then features and trees row by row."""
    table = model_features(stream_lags(readings, lags, cols=cols), lags, cols)
    return predict.prediction_frame(jobs.batch_score(model, table, model_names(lags, cols), cols), "prediction", horizon_min, cols)


_STORE = "spark.sql.streaming.stateStore.providerClass"


_FOLDERS = T.StructType().add("_batch", T.LongType()).add("_day", T.DateType())


@contextmanager
def with_state(spark: SparkSession) -> Iterator[None]:
    """Streams that are started inside keep their state in RocksDB, which timers and lists need; the session's own setting comes back."""
    before = spark.conf.get(_STORE)
    spark.conf.set(_STORE, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.set(_STORE, before)


def stream_scorer(readings: DataFrame, scorer: jobs.Scorer, path: str, late: str = "1 day", history_days: int = 15, cols: Cols = COLS) -> DataStreamWriter:
    """A stream that scores arriving rows as ``jobs.score_rows`` scores a table: all features of the stored scorer, those of other sensors and other days included.

    Rows are put in order first, so that a batch holds all rows of its span of time, of every sensor. Each batch is scored against the scorer's history and
    the rows of earlier batches, which are kept under ``path`` by day and batch, and only the last ``history_days`` of them are read. A batch that is
    run again writes the same folders again.
    """
    spark = readings.sparkSession
    kept, order = f"{path}/history", stream_in_order(readings, late, cols)
    spark.createDataFrame([], order.schema).write.mode("ignore").parquet(f"{kept}/_batch=-1/_day=1970-01-01")

    def score(batch: DataFrame, number: int) -> None:
        rows = batch.select(cols.sensor, cols.date, cols.value).persist()
        try:
            first = rows.agg(F.min(cols.date)).first()[0]
            if first is not None:
                known = scorer.history.select(cols.sensor, cols.date, cols.value, cols.test)
                since = F.lit(first) - minutes(1440 * history_days)
                earlier = spark.read.schema(T.StructType([*rows.schema, *_FOLDERS])).parquet(kept).filter((F.col("_batch") < number) & (F.col("_day") >= F.to_date(since)))
                history = known.unionByName(earlier.select(cols.sensor, cols.date, cols.value, F.lit(True).alias(cols.test))).filter(F.col(cols.date) >= since)
                jobs.score_rows(rows, replace(scorer, history=history), cols).write.mode("overwrite").parquet(f"{path}/scored/batch={number}")
                rows.withColumn("_day", F.to_date(cols.date)).write.mode("overwrite").partitionBy("_day").parquet(f"{kept}/_batch={number}")
        finally:
            rows.unpersist()

    return order.writeStream.foreachBatch(score).option("checkpointLocation", f"{path}/checkpoint")


def scored(spark: SparkSession, path: str) -> DataFrame:
    """What a ``stream_scorer`` has written so far."""
    return spark.read.parquet(f"{path}/scored").drop("batch")


def run_available(stream: DataFrame, path: str) -> DataFrame:
    """Run a stream over what its source holds, into Parquet, and read the result. Run again with the same path, it goes on from where it stopped."""
    with with_state(stream.sparkSession):
        stream.writeStream.format("parquet").option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start(f"{path}/out").awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{path}/out")


def run_arrivals(df: DataFrame, build: Callable[[DataFrame], DataFrame], path: str, slices: int = 3) -> DataFrame:
    """The result of a stream whose rows arrive by their column ``slice``: each slice is written, in as many files as Spark makes of it, and the stream is started again."""
    spark, out = df.sparkSession, None
    schema = df.drop("slice").schema
    for k in range(slices):
        df.filter(F.col("slice") == k).drop("slice").write.mode("append").parquet(f"{path}/in")
        out = run_available(build(spark.readStream.schema(schema).parquet(f"{path}/in")), path)
    return out


def arrivals(df: DataFrame, number: Column, cols: Cols = COLS) -> DataFrame:
    """A month in three slices of ten days; every 20th row comes a slice late, every 25th twice."""
    k = F.floor((F.dayofmonth(cols.date) - 1) / 10)
    slice_ = F.least(F.lit(2), k + (number % 20 == 0).cast("int")).cast("int")
    return df.withColumns({"slice": slice_, "_times": F.when(number % 25 == 1, 2).otherwise(1)}).withColumn("_t", F.explode(F.sequence(F.lit(1), "_times"))).drop("_times", "_t")


def _path(spark: SparkSession) -> str:
    return f"{jobs.shared_dir(spark)}/stream-{uuid.uuid4().hex}"


def grid_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = arrivals(tables.readings_irregular(spark, sf_dir), F.col("event_id")).select("sensor_id", "date", "value", "slice")
    return run_arrivals(rows, stream_grid, _path(spark))


def _hours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly readings as they arrive; the number of a row is that of its hour and sensor."""
    number = F.floor(F.unix_seconds("date") / 3600) + F.substring("sensor_id", 2, 2).cast("int")
    return arrivals(tables.readings(spark, sf_dir), number)


def flags_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    path, df = _path(spark), tables.readings_split(spark, sf_dir)
    jobs.save_states(jobs.fit_states(df.filter("not test_set")), f"{path}/states")
    rows = df.withColumn("slice", F.floor((F.dayofmonth("date") - 1) / 10).cast("int"))
    return run_arrivals(rows, lambda stream: stream_flags(stream, jobs.load_states(spark, f"{path}/states")), path)


def score_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run_arrivals(_hours(spark, sf_dir), stream_score, _path(spark))


def order_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run_arrivals(_hours(spark, sf_dir), stream_in_order, _path(spark))


def scorer_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The test rows, in three arrivals out of order, through a stored scorer with all its features."""
    path, df = _path(spark), tables.readings_split(spark, sf_dir)
    jobs.fit_scorer(df, tables.edges(spark, df), f"{path}/scorer", config=jobs.BuildConfig(lags=25), max_iter=5)
    scorer, rows = jobs.load_scorer(spark, f"{path}/scorer"), _hours(spark, sf_dir).filter("date >= '2024-01-21'")
    run_scorer(rows, scorer, path)
    return scored(spark, path)


def run_scorer(rows: DataFrame, scorer: jobs.Scorer, path: str, slices: int = 3) -> None:
    """``stream_scorer`` over rows that arrive by their column ``slice``, started again for each."""
    spark, schema = rows.sparkSession, rows.drop("slice").schema
    for k in range(slices):
        rows.filter(F.col("slice") == k).drop("slice").write.mode("append").parquet(f"{path}/in")
        with with_state(spark):
            stream_scorer(spark.readStream.schema(schema).parquet(f"{path}/in"), scorer, path).trigger(availableNow=True).start().awaitTermination()


def model_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _path(spark)
    fit_stream_model(tables.readings_split(spark, sf_dir).filter("not test_set"), f"{path}/model")
    return run_arrivals(_hours(spark, sf_dir), lambda stream: stream_model_score(stream, PipelineModel.load(f"{path}/model")), path)
