"""Small helpers that the training-data operators share."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.base import shared_dir

#: Words of the contracts: runs of anything but ASCII white space. ``bytes.split()`` cuts at just these bytes.
WORD = r"[^\x20\x09-\x0D]+"


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage with a checkpoint in the shared folder; survives the loss of executors."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def none_to_empty(texts: Iterable[str | None]) -> list[str]:
    return ["" if t is None else t for t in texts]


def sha256_hex(c: Column) -> Column:
    return F.sha2(c, 256)
