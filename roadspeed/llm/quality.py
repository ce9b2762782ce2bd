"""Quality rules: hashed n-gram log-likelihood ratio between a trusted-target and the raw-corpus multinomial.

Word 1- and 2-grams of every document are hashed into ``n_buckets``; one pass counts the buckets over the whole corpus and
over the trusted documents (Spark sums per-task counts, so the model is ``n_buckets`` rows at most). A second pass scores
each document by the mean of log p_target - log p_raw over its n-grams (its own counts taken out) and keeps it if the score reaches ``threshold``.

Defined cases: a null or empty text has no words, fails the base rules and scores 0. Without trusted documents every score
is 0, so only the base rules decide. Repeated document rows are counted and returned as often as they occur; a document is
trusted if any label row says so. Other columns are left out.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WHITE_SPACE = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
#: Longest trusted id list that is broadcast; beyond it the flag comes by a shuffled join.
BROADCAST_IDS = 4_000_000
_MIX, _SPREAD = np.uint64(0x9E3779B1), np.uint64(0x9E3779B97F4A7C15)


def repeated_words(words: list[bytes]) -> int:
    """Words in 3-word windows that occur twice or more."""
    n = len(words)
    if n < 4:
        return 0
    number = {w: i for i, w in enumerate(words)}
    ids = np.fromiter(map(number.__getitem__, words), np.int64, n)
    if n < 1 << 21:
        keys = (ids[:-2] * n + ids[1:-1]) * n + ids[2:]
    else:
        keys = np.unique(ids[:-2] * n + ids[1:-1], return_inverse=True)[1] * n + ids[2:]
    ordered = np.sort(keys)
    twice = ordered[1:][ordered[1:] == ordered[:-1]]
    if not len(twice):
        return 0
    at = np.flatnonzero(np.isin(keys, twice))
    covered = np.zeros(n, bool)
    for shift in range(3):
        covered[at + shift] = True
    return int(covered.sum())


def repeated_lines(text: str) -> int:
    """Lines with a word that equal an earlier line."""
    if "\n" not in text:
        return 0
    lines = [x for x in text.split("\n") if x.strip(WHITE_SPACE)]
    return len(lines) - len(set(lines))


def base_rules(text: str | None, words: list[bytes]) -> tuple[int, int, int, int, int, bool]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed."""
    text, n = text or "", len(words)
    repeat = repeated_words(words)
    return n, len(text) - sum(map(text.count, WHITE_SPACE)), sum(map(text.count, SYMBOLS)), repeated_lines(text), repeat, n < 50 or 100 * repeat > 50 * n


def buckets(words: list[bytes], n_buckets: int) -> np.ndarray:
    """Buckets of the 1- and 2-grams of words; ``n_buckets`` is a power of two."""
    one = np.fromiter(map(zlib.crc32, words), np.uint64, len(words))
    grams = np.concatenate([one, one[:-1] * _MIX + one[1:]]) if len(words) > 1 else one
    return ((grams * _SPREAD) >> np.uint64(65 - n_buckets.bit_length())).astype(np.int64)


def bucket_counts(docs: DataFrame, trusted_col: str, n_buckets: int, text_col: str = "text") -> DataFrame:
    """bucket, target, raw: counts over the trusted and over all documents; buckets without any are left out."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        target, raw = np.zeros(n_buckets, np.int64), np.zeros(n_buckets, np.int64)
        for batch in batches:
            for text, trusted in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                if (t := text.as_py()) and (words := t.encode().split()):
                    found = buckets(words, n_buckets)
                    np.add.at(raw, found, 1) if len(found) < 2000 else np.add(raw, np.bincount(found, minlength=n_buckets), out=raw)
                    if trusted:
                        np.add.at(target, found, 1)
        used = np.flatnonzero(raw)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(target[used]), pa.array(raw[used])], ["bucket", "target", "raw"])

    part = docs.select(text_col, trusted_col).mapInArrow(count, "bucket long, target long, raw long")
    return part.groupBy("bucket").agg(F.sum("target").alias("target"), F.sum("raw").alias("raw"))


def flag_trusted(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Documents with the extra column ``_trusted``."""
    ids = labels.filter("quality = 1").select(F.col(id_col).alias("_trusted_id")).distinct()
    ids = F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids
    return docs.join(ids, docs[id_col] == ids["_trusted_id"], "left").withColumn("_trusted", F.col("_trusted_id").isNotNull()).drop("_trusted_id")


def corpus_counts(flagged: DataFrame, n_buckets: int, text_col: str = "text") -> np.ndarray:
    """Counts by bucket: row 0 of the trusted documents, row 1 of all. At most ``n_buckets`` rows reach the driver."""
    counts = np.zeros((2, n_buckets))
    for bucket, target, raw in bucket_counts(flagged, "_trusted", n_buckets, text_col).toLocalIterator():
        counts[:, bucket] = target, raw
    return counts


def log_ratio(found: np.ndarray, trusted: bool, counts: np.ndarray, kappa: float) -> float:
    """Mean over a document's n-grams of log p_target - log p_raw.

    Raw counts are scaled to the size of the target, and ``kappa`` is added to both, so rare n-grams say little. The
    document's own n-grams are taken out of the counts: it is judged by the other documents alone.
    """
    if not len(found) or not (total := counts[0].sum()):
        return 0.0
    u, n = np.unique(found, return_counts=True)
    target, raw = counts[0, u] - n * trusted, (counts[1, u] - n) * (total / counts[1].sum())
    return float((n * np.log((target + kappa) / (raw + kappa))).sum() / len(found))


def score(
    docs: DataFrame, labels: DataFrame, n_buckets: int = 1 << 16, kappa: float = 3.0, threshold: float = -0.15, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row per document row: id, the base counts, base_failed, score and kept."""
    flagged = flag_trusted(docs.select(id_col, text_col), labels, id_col)
    model = docs.sparkSession.sparkContext.broadcast(corpus_counts(flagged, n_buckets, text_col))

    def judge(texts: pd.Series, trusted: pd.Series) -> pd.DataFrame:
        rows = []
        for text, flag in zip(texts, trusted, strict=True):
            words = (text or "").encode().split()
            base = base_rules(text, words)
            s = log_ratio(buckets(words, n_buckets), flag, model.value, kappa)
            rows.append((*base, s, not base[-1] and s >= threshold))
        return pd.DataFrame(rows, columns=["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "score", "kept"])

    schema = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, score double, kept boolean"
    return flagged.select(F.col(id_col), F.pandas_udf(judge, schema)(text_col, "_trusted").alias("_q")).select(id_col, "_q.*")
