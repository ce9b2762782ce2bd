"""Training-data pipeline over ``documents``: language ID, near-duplicates, decontamination, PII, tokens.

Every stage takes (spark, docs, sf_dir) and works on all that its predecessor kept; all but the last return the columns of
``documents``. Null and empty texts, and those without a letter, have no language and go in the first. Repeated rows become one
in the second, where rows with one id and different texts, and rows without an id, are documents of their own. Empty tables
give empty ones; other columns stay as they are, but in the last stage.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from roadspeed.llm import decontaminate, language, near, pieces, pii
from roadspeed.llm.common import read, shared_dir


#: Rows of an Arrow batch: texts are large, and each Python worker holds a batch several times over.
BATCH_ROWS = 1000


def small_batches(spark: SparkSession) -> None:
    """Bound what Python workers hold at once. The setting is read when a stage's rows are written, so it stays."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a recognisable language go."""
    small_batches(spark)
    model = language.fit(docs)
    return docs.filter(language.language(docs, model, F.col("text"))["lang_pred"] != language.UNKNOWN)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five-word shingles, Jaccard similarity 0.8 or more) stays, see ``simhash.keep_first``.

    Candidates come from operator 6's popcount grid and, beyond its three bits, from MinHash cells; whole sets decide.
    """
    small_batches(spark)
    return near.keep_one(docs)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a twentieth or more of benchmark words go."""
    small_batches(spark)
    return decontaminate.keep_clean(docs, read(spark, sf_dir, "benchmark"))


def redact_pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data become ``<kind>``; ``n_chars`` follows the new text."""
    small_batches(spark)
    return docs.withColumn("text", pii.redact(F.col("text"))).withColumn("n_chars", F.length("text").cast("long"))


def tokenise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, ids, n_tokens, n_chunks."""
    small_batches(spark)
    return pieces.encode(docs, keep=("lang", "source"))


ORACLE_SQL = None
STAGES = [("language_id", language_id), ("near_dedup", near_dedup), ("decontaminate", drop_benchmark), ("pii", redact_pii), ("sentencepiece", tokenise)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to ``documents``, each written as Parquet in the shared folder and read again."""
    docs = read(spark, sf_dir, "documents")
    folder = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs
