"""Fitted trees as one expression: scores come from generated code over the columns, without feature vectors, on tables, on streams and in other SQL engines.

A model's text form (``toDebugString``) has every split and leaf with all digits, so it is all that is read of a model; it may as well come from a file.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.ml import PipelineModel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Most nodes that one expression holds. Beyond, generated code passes the size that the JVM compiles, and a model's own ``transform`` is faster.
MAX_NODES = 4_000
_LINE = re.compile(r"\s*(?:Tree \d+ \(weight (?P<weight>\S+)\):|(?P<branch>If|Else) \(feature (?P<feature>\d+) (?P<sign><=|>) (?P<at>\S+)\)|Predict: (?P<leaf>\S+))\s*$")


@dataclass(frozen=True)
class Split:
    """Rows whose feature is at most ``at`` go left."""

    feature: str
    at: float
    left: Split | float
    right: Split | float


def parse_trees(text: str, names: list[str]) -> list[tuple[float, Split | float]]:
    """Weight and root of each tree of a text form; ``names`` are the features by number. A text of one tree has weight 1."""
    lines = [m for m in map(_LINE.match, text.splitlines()) if m]
    at = 0

    def node() -> Split | float:
        nonlocal at
        m = lines[at]
        at += 1
        if m["leaf"]:
            return float(m["leaf"])
        left = node()
        other = lines[at]
        if m["branch"] != "If" or m["sign"] != "<=" or other["branch"] != "Else" or (other["feature"], other["at"]) != (m["feature"], m["at"]):
            raise ValueError(f"not a numeric split: {m[0].strip()}, {other[0].strip()}")
        at += 1
        return Split(names[int(m["feature"])], float(m["at"]), left, node())

    out = []
    while at < len(lines):
        weight = 1.0
        if lines[at]["weight"]:
            weight = float(lines[at]["weight"])
            at += 1
        out.append((weight, node()))
    return out


def count_nodes(tree: Split | float) -> int:
    return 1 if isinstance(tree, float) else 1 + count_nodes(tree.left) + count_nodes(tree.right)


def _case(tree: Split | float, quote: str) -> str:
    if isinstance(tree, float):
        return f"CAST({tree!r} AS DOUBLE)"
    return f"CASE WHEN CAST({quote}{tree.feature}{quote} AS DOUBLE) <= CAST({tree.at!r} AS DOUBLE) THEN {_case(tree.left, quote)} ELSE {_case(tree.right, quote)} END"


def _sum(terms: list[str]) -> str:
    """A balanced sum, so that many trees do not nest deeply."""
    if len(terms) < 2:
        return terms[0] if terms else "CAST(0 AS DOUBLE)"
    half = len(terms) // 2
    return f"({_sum(terms[:half])} + {_sum(terms[half:])})"


def to_sql(trees: list[tuple[float, Split | float]], quote: str = "`") -> str:
    """The weighted sum of the trees as SQL; ``quote`` goes around column names ('"' in most engines). Features must not be null."""
    return _sum([f"CAST({w!r} AS DOUBLE) * {_case(t, quote)}" for w, t in trees])


def trees_of(model: PipelineModel) -> list[tuple[float, Split | float]]:
    """Trees of a fitted pipeline of an assembler and a tree model."""
    assembler, fitted = model.stages
    return parse_trees(fitted.toDebugString, assembler.getInputCols())


def expression(model: PipelineModel) -> Column | None:
    """The model's prediction as a column, or None if it has more nodes than one expression holds."""
    trees = trees_of(model)
    return F.expr(to_sql(trees)) if sum(count_nodes(t) for _, t in trees) <= MAX_NODES else None


def predict(df: DataFrame, model: PipelineModel) -> DataFrame:
    """``df`` with the model's ``prediction``: by generated code where the model is small enough, else by the model's own ``transform``."""
    found = expression(model)
    return model.transform(df).drop("features") if found is None else df.withColumn("prediction", found)
