"""Exact quantiles without one task that holds all values.

A mergeable sketch brackets the rank that is asked for; a counting pass says how many values lie below the bracket and inside, and sketches
those inside, which brackets the rank anew; only the values of the last bracket are counted by value and put in order. Each round leaves
some 3 in 1,024 values, so two rounds leave ten million of 10^12. The result is that of ``percentile``, ties included.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Steps of a sketch, and its accuracy: the error of a rank, n / ACCURACY, is far below a step.
STEPS, ACCURACY = 1024, 20_000


def _joined(df: DataFrame, side: DataFrame, by: list[str]) -> DataFrame:
    """``side`` has a row for each group, its keys named _k0, _k1, ...; without groups one row."""
    if not by:
        return df.join(F.broadcast(side), F.lit(True))
    same = reduce(lambda a, b: a & b, (F.col(c).eqNullSafe(F.col(f"_k{i}")) for i, c in enumerate(by)))
    return df.join(side, same)


def _round(rows: DataFrame, by: list[str], ps: list[float], inside: list[Column], below: list[Column], more: list[Column]) -> DataFrame:
    """By group: number of values, and for each quantile those below its bracket, those inside, and a sketch of them; and ``more``."""
    # One literal in place of a thousand, which the optimizer would walk through again and again.
    steps, v = F.split(F.lit(",".join(str(i / STEPS) for i in range(STEPS + 1))), ",").cast("array<double>"), F.col("_v")
    out = [F.count("*").alias("_n"), *more]
    for i in range(len(ps)):
        out += [F.count_if(below[i]).alias(f"_below{i}"), F.count_if(inside[i]).alias(f"_inside{i}"), F.percentile_approx(F.when(inside[i], v), steps, ACCURACY).alias(f"_q{i}")]
    return rows.groupBy(*[F.col(c).alias(f"_k{k}") for k, c in enumerate(by)]).agg(*out)


def _rank(p: float) -> Column:
    return (F.col("_n") - 1) * F.lit(float(p))


def _bracketed(state: DataFrame, ps: list[float]) -> DataFrame:
    """New ends of each bracket: two steps of the sketch around the rank. Brackets of few values stay."""
    ends = {}
    for i, p in enumerate(ps):
        many = F.col(f"_inside{i}") > 4 * STEPS
        step = F.floor(F.try_divide(_rank(p) - F.col(f"_below{i}"), F.col(f"_inside{i}")) * STEPS).cast("int")
        ends[f"_lo{i}"] = F.when(many & (step > 1), F.get(f"_q{i}", step - 1)).otherwise(F.col(f"_lo{i}"))
        ends[f"_hi{i}"] = F.when(many & (step + 2 < STEPS), F.get(f"_q{i}", step + 2)).otherwise(F.col(f"_hi{i}"))
    return state.withColumns(ends).drop(*[f"_{x}{i}" for i in range(len(ps)) for x in ("q", "inside", "below")])


def exact_quantiles(df: DataFrame, column: str | Column, quantiles: dict[str, float], by: list[str] | None = None, rounds: int = 2, more: dict[str, Column] | None = None) -> DataFrame:
    """by..., and a column for each name: the quantile of the values that are not null; null where there are none. Three scans of ``df``.

    ``more`` are further aggregates over the rows with a value, taken in the first scan.
    """
    by, names, ps, more = by or [], list(quantiles), list(quantiles.values()), more or {}
    k, every = [f"_k{i}" for i in range(len(by))], F.lit(True)
    rows = df.withColumn("_v", (F.col(column) if isinstance(column, str) else column).cast("double")).filter(F.col("_v").isNotNull())
    none, v = F.lit(None).cast("double"), F.col("_v")
    ends, kept = [f"_{e}{i}" for i in range(len(ps)) for e in ("lo", "hi")], [f"_more{i}" for i in range(len(more))]
    state = _round(rows, by, ps, [every] * len(ps), [~every] * len(ps), [c.alias(x) for x, c in zip(kept, more.values(), strict=True)]).withColumns(dict.fromkeys(ends, none))
    values = rows.select(*by, "_v")
    below = [F.coalesce(v < F.col(f"_lo{i}"), F.lit(False)) for i in range(len(ps))]
    inside = [F.coalesce(v >= F.col(f"_lo{i}"), F.lit(True)) & F.coalesce(v <= F.col(f"_hi{i}"), F.lit(True)) for i in range(len(ps))]
    for _ in range(rounds - 1):
        state = _round(_joined(values, _bracketed(state, ps), by), by, ps, inside, below, [F.first(c).alias(c) for c in (*ends, *kept)])
    # A last count of what is below, and the values inside by how often they occur.
    met = _joined(values, _bracketed(state, ps), by)
    side = [F.when(below[i], -1).when(inside[i], 0) for i in range(len(ps))]
    cells = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), side[i].alias("side"), F.when(side[i] == 0, v).alias("v")) for i in range(len(ps))])).alias("_c")
    found = met.select(*k, "_n", *kept, cells).filter("_c.side is not null")
    counts = found.groupBy(*k, F.col("_c.i").alias("i"), F.col("_c.side").alias("side"), F.col("_c.v").alias("v")).agg(F.count("*").alias("c"), *[F.first(c).alias(c) for c in ("_n", *kept)])
    after = F.sum("c").over(Window.partitionBy(*k, "i").orderBy("side", "v").rowsBetween(Window.unboundedPreceding, 0))
    placed = counts.withColumns({"_to": after, "_from": after - F.col("c")})
    picks = [F.first(c).alias(x) for x, c in zip(more, kept, strict=True)]
    for i, (name, p) in enumerate(zip(names, ps, strict=True)):
        at = lambda x, i=i: F.max(F.when((F.col("i") == i) & (F.col("side") == 0) & (F.col("_from") <= x) & (x < F.col("_to")), F.col("v")))
        a, b, rank = at(F.floor(_rank(p))), at(F.ceil(_rank(p))), (F.max("_n") - 1) * F.lit(float(p))
        picks.append(F.when(a == b, a).otherwise((F.ceil(rank) - rank) * a + (rank - F.floor(rank)) * b).alias(name))
    return placed.groupBy(*[F.col(x).alias(c) for x, c in zip(k, by, strict=True)]).agg(*picks)
