"""End-to-end jobs: training tables, tree model, time-series grid search, scoring from stored states."""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import asdict, dataclass

from pyspark.errors import AnalysisException
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators import clean, features, graph, predict, split
from ..operators.base import COLS, Cols, minutes, shared_dir
from ..sources import tables
from . import trees


@dataclass(frozen=True)
class BuildConfig:
    """What goes into the training tables."""

    lags: int = 25
    neighbors: int = 1
    smooth: int = 5
    minutes_per_row: int = 60
    separate: bool = True
    families: tuple[str, ...] = ()
    upstream: int = 0


#: Momentum and context columns that a table may have besides lags; each is a function of (rows, minutes of a row, columns).
FAMILIES: dict[str, Callable[[DataFrame, int, Cols], DataFrame]] = {
    "slopes": lambda df, _, cols: features.rolling_slope(df, cols=cols),
    "ewma": lambda df, _, cols: features.ewma_mean_slope(df, cols=cols),
    "volatility": lambda df, _, cols: features.rolling_volatility(df, cols=cols),
    "extrema": lambda df, _, cols: features.rolling_extrema(df, cols=cols),
    "low": lambda df, step, cols: features.minutes_since_below(df, 20.0, step, cols=cols),
    "drop": lambda df, _, cols: features.fast_drop_flag(df, cols=cols),
    "context": lambda df, _, cols: features.rolling_context(df, cols=cols),
    "network": lambda df, _, cols: features.network_context(df, cols=cols),
    "dynamics": lambda df, _, cols: features.short_term_dynamics(df, cols=cols),
}


def smoothed(df: DataFrame, config: BuildConfig = BuildConfig(), cols: Cols = COLS) -> DataFrame:
    return clean.smooth_train_test_separately(df, config.smooth, cols=cols) if config.separate else clean.smooth_speeds(df, config.smooth, cols=cols)


def base_features(df: DataFrame, edges: DataFrame, config: BuildConfig = BuildConfig(), congestion: DataFrame | None = None, cols: Cols = COLS) -> DataFrame:
    """Columns that do not depend on the horizon: smoothing, calendar, neighbours (of smoothed values), lags, congestion flag, and what ``config`` adds.

    ``congestion`` are stored thresholds; without any they are those of the train rows. Travel times from upstream are those of ``df``.
    """
    smooth = smoothed(df, config, cols)
    out = features.lag_features(smooth, config.lags, cols=cols)
    for name in config.families:
        out = FAMILIES[name](out, config.minutes_per_row, cols)
    if config.upstream:
        taus = graph.upstream_travel_time(smooth, edges, minutes_per_row=config.minutes_per_row, train_only=True, cols=cols)
        out = graph.upstream_shifted(out, taus, n=config.upstream, cols=cols)
    out = graph.adjacent_values(out, edges, config.neighbors, cols=cols)
    known = features.fit_congestion(smooth.filter(~F.col(cols.test)), cols=cols) if congestion is None else congestion
    return features.calendar_features(features.congestion_flag(out, known, cols=cols), cols)


def features_for_horizon(base: DataFrame, horizon: int, config: BuildConfig = BuildConfig(), cols: Cols = COLS) -> DataFrame:
    """Previous-weekday value and cyclical time of one horizon."""
    ahead = horizon * config.minutes_per_row
    out = graph.previous_weekday_window(base, ahead, 0, 0, config.minutes_per_row, cols=cols)
    return features.cyclical_time(out, ahead, cols=cols).withColumn("horizon", F.lit(horizon))


def finalise_for_horizon(base: DataFrame, horizon: int, config: BuildConfig = BuildConfig(), cols: Cols = COLS) -> DataFrame:
    """Those, and the target."""
    return features.create_target(features_for_horizon(base, horizon, config, cols), horizon, cols=cols)


def stored_base(spark: SparkSession, path: str, schema: T.StructType, buckets: int, cols: Cols = COLS) -> str:
    """Name of the table of the files at ``path``: dealt by sensor into buckets, each in order of time. It lives in the session's catalog, its files outside."""
    name = f"base_{hashlib.md5(path.encode()).hexdigest()}"
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)
    spark.sql(f"CREATE TABLE IF NOT EXISTS {name} ({columns}) USING parquet CLUSTERED BY (`{cols.sensor}`) SORTED BY (`{cols.sensor}`, `{cols.date}`) INTO {buckets} BUCKETS LOCATION '{path}'")
    return name


def build_training_tables(df: DataFrame, edges: DataFrame, path: str, horizons: list[int], config: BuildConfig = BuildConfig(), cols: Cols = COLS, buckets: int | None = None) -> None:
    """Write the tables of all horizons, smallest first, partitioned by horizon and test_set; horizons that are already there are skipped.

    The base is written once, in buckets by sensor (as many as a shuffle has partitions, if no number is given), and each horizon's windows and
    lookups run inside the buckets: none of them shuffles the base again. A run that was stopped goes on with the buckets that it began with.
    """
    spark = df.sparkSession
    base_path, settings = f"{path}/base", f"{path}/buckets"
    if not _exists(spark, base_path):
        base = base_features(df, edges, config, cols=cols)
        buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        spark.createDataFrame([(str(buckets),)], "value string").write.mode("overwrite").text(settings)
        name = stored_base(spark, base_path, base.schema, buckets, cols)
        base.repartition(buckets, cols.sensor).write.insertInto(name, overwrite=True)
    schema = spark.read.parquet(base_path).schema
    name = stored_base(spark, base_path, schema, int(spark.read.text(settings).first()[0]), cols)
    for h in sorted(horizons):
        if not _exists(spark, f"{path}/tables/horizon={h}"):
            finalise_for_horizon(spark.table(name), h, config, cols).drop("horizon").write.partitionBy(cols.test).parquet(f"{path}/tables/horizon={h}")
    spark.sql(f"DROP TABLE {name}")  # the files stay


def _exists(spark: SparkSession, path: str) -> bool:
    """Whether Parquet files were written there, to the end."""
    try:
        spark.read.format("binaryFile").load(f"{path}/_SUCCESS").schema
        return True
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":
            return False
        raise


def feature_names(df: DataFrame, cols: Cols = COLS) -> list[str]:
    """Numeric columns that are neither keys nor targets."""
    out = {"horizon", "target", "target_total_speed", "target_speed_delta", cols.test}
    return [c for c, t in df.dtypes if t in ("int", "bigint", "float", "double", "tinyint") and c not in out]


def fit_tree_model(
    train: DataFrame, names: list[str], target: str = "target", max_depth: int = 4, step_size: float = 0.1, max_iter: int = 10, seed: int = 42, loss: str = "absolute"
) -> PipelineModel:
    """Boosted trees on the absolute or squared loss; rows with a null feature keep the sentinel -1."""
    assembler = VectorAssembler(inputCols=names, outputCol="features")
    trees = GBTRegressor(featuresCol="features", labelCol=target, lossType=loss, maxDepth=max_depth, stepSize=step_size, maxIter=max_iter, seed=seed)
    return Pipeline(stages=[assembler, trees]).fit(train.fillna(-1.0, names))


def batch_score(model: PipelineModel, df: DataFrame, names: list[str], cols: Cols = COLS) -> DataFrame:
    """Adds prediction and y_pred_total = prediction + value."""
    out = trees.predict(df.fillna(-1.0, names), model)
    return out.withColumn("y_pred_total", F.col("prediction") + F.col(cols.value))


# Depths, step sizes and numbers of trees that are tried.
GRID = tuple((d, s, n) for d in (10, 8, 6, 4) for s in (0.1, 0.01) for n in (1000, 750, 500, 250))


def staged_errors(model: PipelineModel, test: DataFrame, names: list[str]) -> list[float]:
    """Mean absolute error on ``test`` after one tree, two trees, ... of a model, in one pass."""
    assembler, fitted = model.stages
    return fitted.evaluateEachIteration(assembler.transform(test.fillna(-1.0, names)), "absolute")


#: Rows of a fit that are work for one task: a fit is many small jobs, each with a task for every partition.
FIT_ROWS = 50_000


def grid_search_ts(
    df: DataFrame, names: list[str], grid: tuple[tuple[int, float, int], ...] = GRID, k: int = 3, target: str = "target", loss: str = "absolute", at_once: int = 4, cols: Cols = COLS
) -> tuple[DataFrame, PipelineModel]:
    """Mean absolute error of every candidate over expanding folds, and the best one fitted again on all rows.

    Candidates that differ in the number of trees alone share a fit: with one seed the first trees of a model are the model with fewer trees, so one
    fit with the most trees tells the errors of all. ``at_once`` fits are submitted side by side, so that the many small jobs of one leave no executor idle.
    Rows are held in partitions of ``FIT_ROWS``, not in as many as a shuffle makes.
    """
    spark = df.sparkSession
    tasks = max(1, -(-df.count() // FIT_ROWS))
    folded = split.ts_folds(df, k, cols=cols).repartition(tasks, cols.sensor, cols.date).sortWithinPartitions(cols.date, cols.sensor).persist()
    most: dict[tuple[int, float], int] = {}
    for depth, step, n in grid:
        most[depth, step] = max(n, most.get((depth, step), 0))

    def errors(job: tuple[tuple[int, float], int]) -> list[float]:
        (depth, step), fold = job
        train, test = split.fold_tables(folded, fold)
        return staged_errors(fit_tree_model(train, names, target, depth, step, most[depth, step], loss=loss), test, names)

    try:
        folded.count()
        jobs = [(c, fold) for c in most for fold in range(1, k + 1)]
        with ThreadPoolExecutor(at_once) as pool:
            found = dict(zip(jobs, pool.map(errors, jobs), strict=True))
    finally:
        folded.unpersist()
    rows = [(depth, step, n, float(sum(found[(depth, step), fold][n - 1] for fold in range(1, k + 1)) / k)) for depth, step, n in grid]
    best = min(rows, key=lambda r: (r[3], r[:3]))
    table = spark.createDataFrame([(*r, r == best) for r in rows], "max_depth int, step_size double, max_iter int, mae double, best boolean")
    return table, fit_tree_model(df.coalesce(tasks), names, target, *best[:3], loss=loss)


# Fitted states: one small table for each transformer
def fit_states(train: DataFrame, cols: Cols = COLS) -> dict[str, DataFrame]:
    return {"ordinal": features.fit_ordinal(train, cols), "congestion": features.fit_congestion(train, cols=cols), "outlier": features.fit_outlier(train, cols=cols)}


def fit_all_states(train: DataFrame, edges: DataFrame | None = None, target: str = "target", minutes_per_row: int = 1, cols: Cols = COLS) -> dict[str, DataFrame]:
    """The states of every transformer: those, target means by sensor, label scaling if there is a target, travel times if there are edges."""
    states = fit_states(train, cols) | {"mean": features.fit_mean(train, cols)}
    if target in train.columns:
        states["labels"] = predict.fit_label_scaling(train, target, cols)
    if edges is not None:
        states["upstream"] = graph.upstream_travel_time(train, edges, minutes_per_row=minutes_per_row, cols=cols)
    return states


def save_states(states: dict[str, DataFrame], path: str) -> None:
    """Each state as a table under ``path``, and the list of their names last, so that a list stands for whole states."""
    for name, state in states.items():
        state.coalesce(1).write.mode("overwrite").parquet(f"{path}/{name}")
    spark = next(iter(states.values())).sparkSession
    spark.createDataFrame([(n,) for n in states], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/names")


def load_states(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    return {r.value: spark.read.parquet(f"{path}/{r.value}") for r in spark.read.text(f"{path}/names").collect()}


def apply_states(df: DataFrame, states: dict[str, DataFrame], target: str = "target", neighbors: int = 1, cols: Cols = COLS) -> DataFrame:
    """The same stack as in training: a column for each state that there is. On streams all but the upstream columns, which need rows in order."""
    out = features.encode_sensor_ordinal(df, states["ordinal"], cols)
    if "mean" in states:
        out = features.encode_sensor_mean(out, states["mean"], cols=cols)
    out = features.outlier_flag(features.congestion_flag(out, states["congestion"], cols=cols), states["outlier"], cols)
    if "labels" in states and target in df.columns:
        out = predict.label_scaling(out, states["labels"], target, cols=cols)
    if "upstream" in states and not df.isStreaming:
        out = graph.upstream_shifted(out, states["upstream"], n=neighbors, cols=cols)
    return out


def residual_workflow(df: DataFrame, names: list[str], test_size: float = 0.5, threshold: float | None = None, max_depth: int = 4, step_size: float = 0.1, max_iter: int = 10, cols: Cols = COLS) -> DataFrame:
    """A second model on the errors of a first: fitted on the earlier rows, applied to the later ones, metrics before and after.

    df: predictions (keys, value, y, y_pred) with the features ``names``; ``model_pred`` and ``model_delta`` are added to them.
    """
    table = predict.residual_table(df, cols=cols)
    parts = split.flag_test_set(table, test_size, cols=cols)
    used = [*names, "model_pred", "model_delta"]
    model = fit_tree_model(parts.filter(~F.col(cols.test)), used, "residual_target", max_depth, step_size, max_iter)
    later = batch_score(model, parts.filter(F.col(cols.test)), used, cols)
    corrected = predict.residual_correction(later, "prediction", threshold)
    return predict.compare_corrections(later, corrected.withColumn("y_pred", F.col("y_corr")))


# A stored scorer: what new rows need to be scored as in training
@dataclass(frozen=True)
class Scorer:
    """A model with the states of its features and the last rows before the new ones."""

    model: PipelineModel
    names: list[str]
    horizon: int
    config: BuildConfig
    congestion: DataFrame
    edges: DataFrame
    history: DataFrame


def fit_scorer(
    df: DataFrame, edges: DataFrame, path: str, horizon: int = 1, config: BuildConfig = BuildConfig(), history_days: int = 15, max_depth: int = 4, step_size: float = 0.1, max_iter: int = 10, cols: Cols = COLS
) -> None:
    """Fit a model on the train rows and store it under ``path`` with all that its features depend on.

    The last ``history_days`` of train rows are stored as they came: lags, neighbours and previous weekdays reach back no further.
    """
    train = df.filter(~F.col(cols.test))
    table = finalise_for_horizon(base_features(df, edges, config, cols=cols), horizon, config, cols).filter(~F.col(cols.test)).persist()
    names = feature_names(table, cols)
    fit_tree_model(table, names, "target", max_depth, step_size, max_iter).write().overwrite().save(f"{path}/model")
    table.unpersist()
    features.fit_congestion(smoothed(df, config, cols).filter(~F.col(cols.test)), cols=cols).write.mode("overwrite").parquet(f"{path}/congestion")
    edges.write.mode("overwrite").parquet(f"{path}/edges")
    last = train.agg((F.max(cols.date) - minutes(history_days * 1440)).alias("_from"))  # one row
    train.join(F.broadcast(last), F.col(cols.date) > F.col("_from")).drop("_from").write.mode("overwrite").parquet(f"{path}/history")
    settings = json.dumps({"names": names, "horizon": horizon, "config": asdict(config)})
    df.sparkSession.createDataFrame([(settings,)], "value string").write.mode("overwrite").text(f"{path}/settings")


def load_scorer(spark: SparkSession, path: str) -> Scorer:
    settings = json.loads(spark.read.text(f"{path}/settings").first()[0])
    tables_of = [spark.read.parquet(f"{path}/{x}") for x in ("congestion", "edges", "history")]
    return Scorer(PipelineModel.load(f"{path}/model"), settings["names"], settings["horizon"], BuildConfig(**{k: tuple(v) if isinstance(v, list) else v for k, v in settings["config"].items()}), *tables_of)


def score_rows(new: DataFrame, scorer: Scorer, cols: Cols = COLS, warm_up: bool = False) -> DataFrame:
    """Prediction frame of new rows (sensor, date, value): the features of training from the stored states and the history, then the stored model.

    History rows keep their own flag of the test set. A new row whose (sensor, date) the history holds already is left out. ``warm_up`` leaves out rows with fewer
    earlier rows of their sensor than the model has lags; without it their missing lags are the sentinel.
    """
    rows = new.select(cols.sensor, cols.date, cols.value).withColumns({cols.test: F.lit(True), "_new": F.lit(True)})
    known = scorer.history.select(cols.sensor, cols.date, cols.value, cols.test).withColumn("_new", F.lit(False))
    both = known.unionByName(rows)
    twice = F.bool_or(~F.col("_new")).over(Window.partitionBy(cols.sensor, cols.date))
    whole = both.withColumn("_old", twice).filter(~F.col("_new") | ~F.col("_old")).drop("_old")
    table = features_for_horizon(base_features(whole, scorer.edges, scorer.config, scorer.congestion, cols), scorer.horizon, scorer.config, cols)
    if warm_up:
        table = clean.trim_warmup(table, scorer.config.lags, cols)
    scored = batch_score(scorer.model, table.filter("_new"), scorer.names, cols)
    return predict.prediction_frame(scored, "prediction", scorer.horizon * scorer.config.minutes_per_row, cols)


# Queries over the test tables
def build_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{shared_dir(spark)}/tables-{uuid.uuid4().hex}"
    build_training_tables(tables.readings_split(spark, sf_dir), tables.edges(spark, tables.readings(spark, sf_dir)), path, [3, 1])
    return spark.read.parquet(f"{path}/tables").withColumn("test_set", F.col("test_set").cast("boolean"))  # a partition column is read as text


def _table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return finalise_for_horizon(base_features(tables.readings_split(spark, sf_dir), tables.edges(spark, tables.readings(spark, sf_dir)), BuildConfig()), 1)


def _stored_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table, written once: it is read for each fit."""
    _table(spark, sf_dir).write.parquet(path := f"{shared_dir(spark)}/table-{uuid.uuid4().hex}")
    return spark.read.parquet(path)


def fit_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _stored_table(spark, sf_dir)
    names = feature_names(df)
    return batch_score(fit_tree_model(df.filter("not test_set"), names), df.filter("test_set"), names)


#: What the query tries: as many depths, steps and numbers of trees as ``GRID``, but smaller ones, since a fit of a thousand trees takes minutes.
QUERY_GRID = tuple((d, s, n) for d in (5, 4, 3, 2) for s in (0.1, 0.3) for n in (8, 6, 4, 2))


def grid_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _stored_table(spark, sf_dir).filter("not test_set")
    return grid_search_ts(df, feature_names(df), QUERY_GRID)[0]


def score_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A model that was saved and loaded again."""
    df = _stored_table(spark, sf_dir)
    names, path = feature_names(df), f"{shared_dir(spark)}/model-{uuid.uuid4().hex}"
    fit_tree_model(df.filter("not test_set"), names, max_iter=5).save(path)
    return batch_score(PipelineModel.load(path), df.filter("test_set"), names)


def new_rows_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """New rows scored from stored states alone."""
    df, path = tables.readings_split(spark, sf_dir), f"{shared_dir(spark)}/scorer-{uuid.uuid4().hex}"
    fit_scorer(df, tables.edges(spark, df), path, max_iter=5)
    return score_rows(df.filter("test_set"), load_scorer(spark, path))


def states_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    df, path = tables.readings_split(spark, sf_dir), f"{shared_dir(spark)}/states-{uuid.uuid4().hex}"
    save_states(fit_states(df.filter("not test_set")), path)
    return apply_states(df.filter("test_set"), load_states(spark, path))


def all_states_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every transformer fitted on the train rows, stored, loaded and applied to the test rows."""
    df, path = features.create_target(tables.readings_split(spark, sf_dir), 1), f"{shared_dir(spark)}/states-{uuid.uuid4().hex}"
    save_states(fit_all_states(df.filter("not test_set")), path)
    return apply_states(df.filter("test_set"), load_states(spark, path))
