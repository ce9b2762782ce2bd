"""Mixing sources to target weights.

Words are summed by source; a source's target is its share, by weight, of all words, at most ``cap`` times what it has, and what is cut
off there is shared again by weight. The target over the source's words is the rate of repetition: each document is taken
floor(rate) times, and once more if a number between 0 and 1, hashed from a seed, its id and its text, is below the fraction.
So every run takes the same documents, whatever the partitions, and no document is taken more than ``cap`` times.

Words are counted where a document lies, partial sums are added by source, and only the table of sources is shuffled. It is
ranked in two levels (sorted by ranges, then numbered by range), and shared out by passes that each bring one row of sums to
the driver; a pass that cuts no further source is the last. The table of sources is broadcast while its size, which is counted, is
below ``BROADCAST_BYTES``; beyond, documents are joined by (source, salt), so that a source with a third of all rows is work
for many tasks.

Defined cases: a null or empty text has no words; it is taken as often as its source's rate says. A source without words has target 0 and rate 0. Null is a source
of its own, the last one. Identical rows (id, text and source) are taken alike; rows with the same id and different texts are not. An empty
table gives no rows. ``mix`` keeps all columns of the documents, whatever their names, but a column of the name ``copy_col`` is replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD, cut

#: Largest table of sources that is broadcast, in bytes of names and 64 for each row; beyond it the documents are joined by source and salt.
BROADCAST_BYTES = 64 << 20
#: Parts into which the documents of every source are dealt for that join.
SALTS = 64
_ROW = "sum(64 + coalesce(octet_length(source), 0))"


def words(text: Column) -> Column:
    """Number of words of the text as a long; 0 without one."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def draw(seed: int, id_col: Column, text: Column) -> Column:
    """A number from [0, 1): 52 bits of an MD5 value."""
    key = F.md5(F.concat_ws(":", F.lit(str(seed)), F.coalesce(id_col.cast("string"), F.lit("")), F.coalesce(text, F.lit(""))))
    return F.conv(F.substring(key, 1, 13), 16, 10).cast("long") / F.lit(float(1 << 52))


def ranked(sources: DataFrame) -> DataFrame:
    """The table with ``rank``, from 0, in order of the code points of ``source``, null last: sorted by ranges, numbered inside each, ranges added up."""
    place = cut(sources.orderBy(F.col("source").asc_nulls_last()).withColumn("_at", F.monotonically_increasing_id()))
    part = F.shiftright("_at", 33)
    before, first = 0, []
    for p, n in place.groupBy(part.alias("p")).agg(F.count("*").alias("n")).orderBy("p").collect():  # one row by range
        first.append((p, before))
        before += n
    offsets = place.sparkSession.createDataFrame(first, "_part long, _first long")
    return place.join(F.broadcast(offsets), part == F.col("_part")).withColumn("rank", F.col("_first") + (F.col("_at") - F.shiftleft(F.col("_part"), 33))).drop("_at", "_part", "_first")


def targets(sizes: DataFrame, weights: tuple[int, ...] = (5, 2, 1), cap: int = 3) -> DataFrame:
    """source, source_size, target of a table source, source_size."""
    wide = lambda c: c.cast("decimal(38,0)")
    pick = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("rank") % len(weights) + 1).cast("int"))
    table = cut(ranked(sizes).select("source", "source_size", pick.cast("long").alias("weight")))
    whole = table.agg(F.coalesce(F.sum("source_size"), F.lit(0))).first()[0]
    capped, held, active = F.lit(False), 0, None
    while True:
        # Sources that are cut stay so: what is left, by weight, only grows.
        sums = table.agg(F.coalesce(F.sum(F.when(capped, cap * F.col("source_size"))), F.lit(0)), F.coalesce(F.sum(F.when(~capped, F.col("weight"))), F.lit(0))).first()
        if (sums[0], sums[1]) == (held, active):
            break
        held, active = sums
        capped = (wide(cap * F.col("source_size")) * F.lit(active).cast("decimal(19,0)") < wide(F.col("weight")) * F.lit(whole - held).cast("decimal(19,0)")) if active else F.lit(True)
    share = F.try_divide((F.col("weight") * F.lit(whole - held)).cast("double"), F.lit(float(active or 0)))
    return table.select("source", "source_size", F.when(capped, (cap * F.col("source_size")).cast("double")).otherwise(share).alias("target"))


def allot(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), cap: int = 3, seed: int = 7, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """``row`` (all columns of a document), ``size`` (its words), ``source_size``, ``target`` (words of its source that there are, and that are to be taken) and ``copies``."""
    source = F.col(source_col).cast("string")
    table = targets(docs.groupBy(source.alias("source")).agg(F.sum(words(F.col(text_col))).alias("source_size")), weights, cap)
    small = (table.agg(F.expr(_ROW)).first()[0] or 0) <= BROADCAST_BYTES
    rows = docs.select(F.struct("*").alias("row"), source.alias("_source"), words(F.col(text_col)).alias("size"), draw(seed, F.col(id_col), F.col(text_col)).alias("_draw"))
    if small:
        met = rows.join(F.broadcast(table), F.col("_source").eqNullSafe(F.col("source")))
    else:
        dealt = table.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        met = rows.withColumn("_deal", F.floor(F.col("_draw") * F.lit(float(1 << 26))) % SALTS).join(dealt, F.col("_source").eqNullSafe(F.col("source")) & (F.col("_deal") == F.col("_salt")))
    rate = F.coalesce(F.try_divide(F.col("target"), F.col("source_size").cast("double")), F.lit(0.0))
    copies = F.floor(rate) + (F.col("_draw") < rate - F.floor(rate)).cast("long")
    return met.select("row", "size", "source_size", "target", copies.alias("copies"))


def mix(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), cap: int = 3, seed: int = 7, copy_col: str = "copy", id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The mix itself: every document as often as it is taken, with the number of the copy from 1."""
    taken = allot(docs, weights, cap, seed, id_col, text_col, source_col).filter("copies > 0")
    names = [c for c in docs.columns if c != copy_col]
    return taken.select(*[F.col("row").getField(c).alias(c) for c in names], F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias(copy_col))
