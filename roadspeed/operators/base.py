"""Column names and window specs shared by the operators."""

from __future__ import annotations

import tempfile
from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession, Window, WindowSpec
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Cols:
    """Names of the key and value columns of a readings table."""

    sensor: str = "sensor_id"
    date: str = "date"
    value: str = "value"
    test: str = "test_set"

    def series(self, *more: str) -> WindowSpec:
        """Rows of a sensor in order of time. Every ordered operator uses this spec, so Spark plans one exchange and one sort."""
        return Window.partitionBy(self.sensor, *more).orderBy(self.date)

    def latest_first(self, *more: str) -> WindowSpec:
        return Window.partitionBy(self.sensor, *more).orderBy(F.desc(self.date))

    def trailing(self, w: int, *more: str) -> WindowSpec:
        """The last w rows, this one included."""
        return self.series(*more).rowsBetween(1 - w, 0)


COLS = Cols()


def in_chunks(df: DataFrame, op: Callable[[DataFrame, Cols], DataFrame], hours: int, before: int, after: int = 0, cols: Cols = COLS) -> DataFrame:
    """An operator by (sensor, chunk of time) in place of sensor, so that a long sensor is work for many tasks.

    Each chunk of ``hours`` also gets the rows of the ``before`` and ``after`` hours around it; they must hold as many rows as
    the operator looks back and ahead. Rows keep the columns that the operator adds.
    """
    size, t = hours * 3600, F.unix_seconds(cols.date)
    first, last = F.floor((t - after * 3600) / size), F.floor((t + before * 3600) / size)
    rows = df.withColumns({"_own": F.floor(t / size), "_chunk": F.explode(F.sequence(first, last))})
    done = op(rows.withColumn("_part", F.concat_ws("\x00", cols.sensor, "_chunk")), replace(cols, sensor="_part"))
    return done.filter(F.col("_own") == F.col("_chunk")).drop("_own", "_chunk", "_part")


def summed_before(df: DataFrame, weight: Column, before: str, total: str, date: str = COLS.date, hours: int = 720) -> DataFrame:
    """Adds, to a table of different dates, what a weight adds up to over all earlier dates, and over all of them.

    In two levels: chunks of time are summed, the few sums are put in order, and dates are put in order inside their chunk alone, so that no
    task orders all of them.
    """
    rows = df.withColumns({"_chunk": F.coalesce(F.floor(F.unix_seconds(F.col(date).cast("timestamp")) / (hours * 3600)), F.lit(-(2**60))), "_weight": weight.cast("long")})
    sums = rows.groupBy(F.col("_chunk").alias("_of")).agg(F.sum("_weight").alias("_sum"))
    ahead = F.sum("_sum").over(Window.orderBy("_of").rowsBetween(Window.unboundedPreceding, -1))
    chunks = sums.select("_of", F.coalesce(ahead, F.lit(0)).alias("_ahead"), F.sum("_sum").over(Window.partitionBy()).alias(total))  # a row by chunk of time
    inside = F.sum("_weight").over(Window.partitionBy("_chunk").orderBy(date).rowsBetween(Window.unboundedPreceding, -1))
    out = rows.withColumn("_inside", F.coalesce(inside, F.lit(0))).join(F.broadcast(chunks), F.col("_chunk") == F.col("_of"))
    return out.withColumn(before, F.col("_ahead") + F.col("_inside")).drop("_chunk", "_weight", "_of", "_ahead", "_inside")


def trailing_blocks(df: DataFrame, position: str, reach: int, op: Callable[[DataFrame, Window], DataFrame], size: int = 100_000) -> DataFrame:
    """``op`` with a window over all rows in order of a position (0, 1, 2, ...), in blocks of ``size`` rows that also hold the ``reach`` rows before each.

    ``op`` gets the rows and a window spec to which it adds a frame of at most ``reach`` rows back.
    """
    size = max(size, reach + 1)
    own = F.floor(F.col(position) / size)
    rows = df.withColumns({"_own": own, "_block": F.explode(F.sequence(own, F.floor((F.col(position) + reach) / size)))})
    done = op(rows, Window.partitionBy("_block").orderBy(position))
    return done.filter(F.col("_own") == F.col("_block")).drop("_own", "_block")


def minutes(n: int | Column) -> Column:
    """An interval of n minutes."""
    return F.make_dt_interval(mins=F.lit(n) if isinstance(n, int) else n)


def shared_dir(spark: SparkSession) -> str:
    """The folder that all machines share: ``spark.checkpoint.dir``. Where it is unset, a temporary one, in local mode only."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all machines share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="spark-checkpoint-"))
    return sc.getCheckpointDir()


def configure(spark: SparkSession) -> SparkSession:
    """Session settings that results depend on: one time zone, in which calendar columns and chunks of time are told."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark


def require(df: DataFrame, *names: str) -> DataFrame:
    if missing := [n for n in names if n not in df.columns]:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df
