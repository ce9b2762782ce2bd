"""Token counts from an exact length histogram.

Documents are aggregated by their encoded length. Suffix sums over the histogram then answer, for every context limit c:
how many documents have c tokens or more, all tokens, the tokens left when each document is cut at c, and quantiles.

The suffix sums have two levels, so that no task holds a histogram that grows with the corpus: lengths form blocks of
``BLOCK``, sums run inside each block, and only one row for each block is summed in order.

Defined cases: a null or empty text has no tokens and counts as a document of length 0; repeated rows count each time; an
empty table has an empty histogram. Special-token strings in a text are ordinary text. Other columns are left out.
"""

from __future__ import annotations

import base64
from decimal import Decimal
from functools import lru_cache

import pandas as pd
import tiktoken
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
BLOCK = 1024
#: Fixed value: the pattern that cuts text into the stretches that byte-pair merges stay inside.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@lru_cache(2)
def encoding(path: str) -> tiktoken.Encoding:
    """The tokenizer of a vocabulary file, once for each Python worker."""
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("vocabulary", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def n_tokens(text: Column, path: str = VOCABULARY) -> Column:
    """Tokens of a text; ``path`` is the vocabulary file on each executor."""

    def count(texts: pd.Series) -> pd.Series:
        encode = encoding(path).encode_ordinary
        return pd.Series([len(encode(t)) if t else 0 for t in texts], dtype="int64")

    return F.pandas_udf(count, "long")(text)


def lengths(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str = VOCABULARY) -> DataFrame:
    """One row per document row: id, n_tokens."""
    return docs.select(F.col(id_col), n_tokens(F.col(text_col), path).alias("n_tokens"))


def histogram(counted: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Documents by n_tokens (and by further columns)."""
    return counted.groupBy(*(by or []), "n_tokens").agg(F.count("*").alias("n_docs"))


def suffix_sums(hist: DataFrame) -> DataFrame:
    """For each length n_tokens: n_docs, docs_from (documents as long or longer), tokens_from (their tokens), docs_total, tokens_total, tokens_cut, docs_up_to.

    ``tokens_cut`` is the corpus size if every document is truncated at that length; the first length with a ``docs_up_to``
    of at least a share of ``docs_total`` is the quantile of that share.
    """
    rows = hist.withColumn("block", F.floor(F.col("n_tokens") / BLOCK)).withColumn("_tokens", F.col("n_tokens") * F.col("n_docs"))
    blocks = rows.groupBy("block").agg(F.sum("n_docs").alias("_bd"), F.sum("_tokens").alias("_bt"))
    later = Window.orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    above = blocks.select(
        "block",
        F.coalesce(F.sum("_bd").over(later), F.lit(0)).alias("_docs_above"),
        F.coalesce(F.sum("_bt").over(later), F.lit(0)).alias("_tokens_above"),
        F.sum("_bd").over(whole).alias("docs_total"),
        F.sum("_bt").over(whole).alias("tokens_total"),
    )
    inside = Window.partitionBy("block").orderBy(F.desc("n_tokens")).rowsBetween(Window.unboundedPreceding, 0)
    docs_from = F.sum("n_docs").over(inside) + F.col("_docs_above")
    tokens_from = F.sum("_tokens").over(inside) + F.col("_tokens_above")
    out = rows.join(above, "block").select("n_tokens", "n_docs", docs_from.alias("docs_from"), tokens_from.alias("tokens_from"), "docs_total", "tokens_total")
    out = out.withColumn("tokens_cut", F.col("tokens_total") - F.col("tokens_from") + F.col("docs_from") * F.col("n_tokens"))
    return out.withColumn("docs_up_to", F.col("docs_total") - F.col("docs_from") + F.col("n_docs"))


def totals_at(sums: DataFrame, limits: list[int]) -> DataFrame:
    """For each context limit: docs_over (longer than it), tokens_cut, tokens_lost. Every limit is answered, histogram length or not."""
    asked = sums.sparkSession.createDataFrame([(c,) for c in limits], "context long")
    # The shortest length beyond the limit holds the suffix that is cut. Each length meets each limit in its own row's array, so nothing is joined.
    each = sums.withColumn("context", F.explode(F.array(*map(F.lit, limits)).cast("array<long>")))
    beyond = F.when(F.col("n_tokens") > F.col("context"), F.struct("n_tokens", "docs_from", "tokens_from"))
    out = asked.join(each.groupBy("context").agg(F.min(beyond).alias("s"), F.max("tokens_total").alias("tokens_total")), "context", "left")
    docs_over, lost = F.coalesce("s.docs_from", F.lit(0)), F.coalesce(F.col("s.tokens_from") - F.col("s.docs_from") * F.col("context"), F.lit(0))
    return out.select("context", docs_over.alias("docs_over"), (F.coalesce("tokens_total", F.lit(0)) - lost).alias("tokens_cut"), lost.alias("tokens_lost"))


def quantiles(sums: DataFrame, shares: list[float]) -> DataFrame:
    """The smallest length that at least a share q of the documents do not exceed, for each q in (0, 1], as written in decimals."""
    exact = [F.struct(F.lit(q).cast("double").alias("q"), F.lit(Decimal(str(q))).cast("decimal(18,17)").alias("share")) for q in shares]
    if not shares:
        return sums.select(F.lit(0.0).alias("q"), "n_tokens").limit(0)
    each = sums.select("n_tokens", "docs_up_to", "docs_total", F.explode(F.array(*exact)).alias("_q"))
    return each.filter(F.col("docs_up_to") >= F.col("_q.share") * F.col("docs_total")).groupBy("_q.q").agg(F.min("n_tokens").alias("n_tokens"))


def length_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str = VOCABULARY) -> DataFrame:
    """The suffix sums of the documents' lengths."""
    return suffix_sums(cut(histogram(lengths(docs, id_col, text_col, path))))  # read twice, for both levels
