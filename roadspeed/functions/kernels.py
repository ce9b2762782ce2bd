"""Recurrences without a Spark built-in, as parallel prefixes: exponential means and the Kalman smoother.

Rows are dealt by (sensor, chunk of time) in one exchange, so that a long sensor is work for many tasks. A first pass in
Python gives each chunk's effect on what comes before it (an affine map of the state, since both recurrences are
affine in it), a few numbers for each chunk; these are combined in order of time, sensor by sensor; a second pass runs each chunk
from the state that it starts with. The passes read the same exchange, so rows are shuffled once. Inside a pass the rows of many
chunks are scanned at once; a task holds one chunk at a time, or some ten thousand rows of smaller ones.

A missing sensor is a series of its own; rows without a date come first.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.base import COLS, Cols

#: Hours of a chunk of time: 2.6 million rows of a sensor that reads every second.
CHUNK_HOURS = 720
#: Rows that are scanned at once, if no chunk has more.
BLOCK = 65_536
_KEYS = ("_series", "_chunk")
#: Weights below this add nothing.
_TINY = 1e-200

Block = tuple[pa.Table, np.ndarray]


def affine_scan(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """y of y[i] = a[i] y[i-1] + b[i], from nothing before the first: maps are joined over spans of 1, 2, 4, ... rows. Where a is 0, a series begins anew."""
    a, b, step = a.copy(), b.copy(), 1
    a[:1] = 0
    while step < len(a) and a[step:].any():
        b[step:] = b[step:] + a[step:] * b[:-step]
        a[step:] = a[step:] * a[:-step]
        a[np.abs(a) < _TINY] = 0
        step *= 2
    return b


def _starts(table: pa.Table, names: tuple[str, ...]) -> np.ndarray:
    """Places at which a row differs in one of the columns from the row before."""
    new = np.zeros(table.num_rows, bool)
    new[:1] = True
    for name in names:
        c = table.column(name)
        new[1:] |= pc.not_equal(c.slice(1), c.slice(0, len(c) - 1)).to_numpy()
    return np.flatnonzero(new)


def _blocks(batches: Iterator[pa.RecordBatch], names: tuple[str, ...]) -> Iterator[Block]:
    """Rows of sorted batches with the places where groups start; no group is cut."""
    held, rows, enough = [], 0, BLOCK
    for batch in batches:
        held.append(batch)
        rows += batch.num_rows
        if rows < enough:
            continue
        table = pa.Table.from_batches(held)
        starts = _starts(table, names)
        if not (cut := int(starts[-1])):
            enough = 2 * rows
            continue
        yield table.slice(0, cut), starts[:-1]
        held, rows, enough = table.slice(cut).to_batches(), rows - cut, BLOCK
    if rows:
        table = pa.Table.from_batches(held)
        yield table, _starts(table, names)


def _numbers(table: pa.Table, name: str) -> np.ndarray:
    return table.column(name).cast(pa.float64()).to_numpy()


def _groups(starts: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Number of the group of each row, and the last row of each group."""
    return np.repeat(np.arange(len(starts)), np.diff(starts, append=n)), np.append(starts[1:], n) - 1


class Chunks:
    """Rows of a frame by (sensor, chunk of time), and passes over them."""

    def __init__(self, df: DataFrame, hours: int, cols: Cols):
        self.cols, self.names = cols, df.columns
        chunk = F.floor(F.unix_seconds(F.col(cols.date).cast("timestamp")) / (hours * 3600))
        series = F.coalesce(F.col(cols.sensor).cast("string"), F.lit("\x00"))
        self.rows = df.withColumns({"_series": series, "_chunk": F.coalesce(chunk, F.lit(-(2**60)))}).repartition(*_KEYS)

    def _pass(self, rows: DataFrame, run: Callable[[pa.Table, np.ndarray], pa.Table], schema: T.StructType, order: tuple[str, ...], groups: tuple[str, ...]) -> DataFrame:
        def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for table, starts in _blocks(batches, groups):
                yield from run(table, starts).to_batches()

        return rows.sortWithinPartitions(*order).mapInArrow(each, schema)

    def summary(self, run: Callable[[pa.Table, np.ndarray], dict[str, np.ndarray]], names: list[str], heads: DataFrame | None = None) -> DataFrame:
        """A row for each chunk: its keys and the numbers ``names`` that ``run`` gives, with what ``heads`` tells of it."""

        def line(table: pa.Table, starts: np.ndarray) -> pa.Table:
            made = run(table, starts)
            return pa.table([*(table.column(k).take(pa.array(starts)) for k in _KEYS), *(pa.array(made[n], pa.float64()) for n in names)], [*_KEYS, *names])

        schema = T.StructType.fromDDL("_series string, _chunk long, " + ", ".join(f"`{n}` double" for n in names))
        return self._pass(self._met(heads), line, schema, (*_KEYS, self.cols.date), _KEYS)

    def combine(self, summary: DataFrame, run: Callable[[pa.Table, np.ndarray], dict[str, np.ndarray]], names: list[str]) -> DataFrame:
        """``summary`` and the numbers ``names`` that ``run`` gives from the chunks of each sensor in order of time."""

        def line(table: pa.Table, starts: np.ndarray) -> pa.Table:
            made = run(table, starts)
            for n in names:
                table = table.append_column(n, pa.array(made[n], pa.float64()))
            return table

        schema = T.StructType([*summary.schema, *(T.StructField(n, T.DoubleType()) for n in names)])
        return self._pass(summary.repartition("_series"), line, schema, _KEYS, ("_series",))

    def finish(self, heads: DataFrame, run: Callable[[pa.Table, np.ndarray], dict[str, np.ndarray]], names: list[str]) -> DataFrame:
        """The rows of the frame with the columns that ``run`` gives (not-a-number becomes null), with what ``heads`` tells of their chunk."""
        kept = [f for f in self.rows.schema if f.name not in (*_KEYS, *names)]
        schema = T.StructType([*kept, *(T.StructField(n, T.DoubleType()) for n in names)])

        def line(table: pa.Table, starts: np.ndarray) -> pa.Table:
            made = run(table, starts)
            return pa.table([*(table.column(f.name) for f in kept), *(pa.array(made[n], pa.float64(), from_pandas=True) for n in names)], schema.names)

        return self._pass(self._met(heads), line, schema, (*_KEYS, self.cols.date), _KEYS)

    def _met(self, heads: DataFrame | None) -> DataFrame:
        """Heads are few: they are hashed, and the rows stay where they are."""
        return self.rows if heads is None else self.rows.join(heads.hint("shuffle_hash"), list(_KEYS))


# Exponential means
class _Gaps:
    """Missing values of groups of rows: what is known, and how far the known value before is."""

    def __init__(self, x: np.ndarray, starts: np.ndarray):
        place = np.arange(len(x))
        self.group, self.last = _groups(starts, len(x))
        self.known = ~np.isnan(x)
        latest = np.maximum.accumulate(np.where(self.known, place, -1))
        before, start = np.append(-1, latest[:-1]), starts[self.group]
        self.none_before = before < start
        self.first = self.known & self.none_before
        self.leading = ~self.known & self.none_before
        self.distance = place - before
        self.ahead = place - start
        size = self.last - starts + 1
        self.lead, self.trail = np.add.reduceat(self.leading, starts), np.minimum(self.last - latest[self.last], size)
        self.size, self.x1 = size, np.full(len(starts), np.nan)
        self.x1[self.group[self.first]] = x[self.first]


def _weights(distance: np.ndarray, alpha: float) -> tuple[np.ndarray, np.ndarray]:
    """Shares of the mean so far and of the new value, if the mean is that many rows old."""
    old = (1 - alpha) ** distance.astype(float)
    return old / (old + alpha), alpha / (old + alpha)


def _means(x: np.ndarray, gaps: _Gaps, alpha: float, before: np.ndarray | None = None, missing: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Means of groups of rows, and the share that each has of the mean at the first known value of the group.

    ``before``: mean ahead of each group (not a number: none), ``missing``: missing values between it and the group.
    """
    old, new = _weights(gaps.distance, alpha)
    values = np.where(gaps.known, x, 0.0)
    a, b = np.where(gaps.known, old, 1.0), np.where(gaps.known, new * values, 0.0)
    share = np.multiply.reduceat(np.where(gaps.none_before, 1.0, a), starts := gaps.last - gaps.size + 1)
    a[gaps.none_before], b[gaps.first] = 0.0, values[gaps.first]
    if before is not None:
        at = gaps.group[gaps.first]
        old, new = _weights(missing[at] + gaps.ahead[gaps.first] + 1, alpha)
        b[gaps.first] = np.where(np.isnan(before[at]), values[gaps.first], old * np.nan_to_num(before[at]) + new * values[gaps.first])
    y = affine_scan(a, b)
    y[gaps.leading] = np.nan if before is None else before[gaps.group[gaps.leading]]
    return y, share


def ewma(df: DataFrame, name: str, alpha: float, cols: Cols = COLS, value: str | None = None, hours: int = CHUNK_HOURS) -> DataFrame:
    """Exponential mean y = (1 - a) y' + a x of each sensor; a gap keeps y and lets the old weight decay."""
    return ewmas(df, {name: alpha}, cols, value, hours=hours)


def ewmas(df: DataFrame, means: dict[str, float], cols: Cols = COLS, value: str | None = None, steps: dict[str, str] | None = None, hours: int = CHUNK_HOURS) -> DataFrame:
    """Exponential means: a column for each name, with its factor a; ``steps`` names columns for the change of a mean since the row before."""
    source, steps, order = value or cols.value, steps or {}, list(means)
    chunks = Chunks(df, hours, cols)
    own = [f"_{x}{i}" for i in range(len(order)) for x in ("share", "end")]
    states = [f"_mean{i}" for i in range(len(order))]

    def effect(table: pa.Table, starts: np.ndarray) -> dict[str, np.ndarray]:
        x = _numbers(table, source)
        gaps = _Gaps(x, starts)
        out = {"_size": gaps.size, "_lead": gaps.lead, "_trail": gaps.trail, "_x1": gaps.x1}
        for i, name in enumerate(order):
            y, out[f"_share{i}"] = _means(x, gaps, means[name])
            out[f"_end{i}"] = y[gaps.last]
        return out

    def join(table: pa.Table, starts: np.ndarray) -> dict[str, np.ndarray]:
        size, lead, trail, x1 = (_numbers(table, n) for n in ("_size", "_lead", "_trail", "_x1"))
        ahead, known = np.cumsum(size) - size, lead < size
        latest = np.maximum.accumulate(np.where(known, ahead + size - 1 - trail, -1))
        before = np.append(-1, latest[:-1])
        there = before >= ahead[starts[_groups(starts, len(size))[0]]]
        out = {"_missing": ahead - 1 - before}
        for i, name in enumerate(order):
            share, end = _numbers(table, f"_share{i}"), np.nan_to_num(_numbers(table, f"_end{i}"))
            old, new = _weights(ahead + lead - before, means[name])
            a = np.where(known, np.where(there, share * old, 0.0), 1.0)
            b = np.where(known, end + np.where(there, share * (new - 1) * np.nan_to_num(x1), 0.0), 0.0)
            out[states[i]] = np.where(there, np.append(0.0, affine_scan(a, b)[:-1]), np.nan)
        return out

    def run(table: pa.Table, starts: np.ndarray) -> dict[str, np.ndarray]:
        x, out = _numbers(table, source), {}
        gaps, missing = _Gaps(x, starts), _numbers(table, "_missing")[starts]
        for i, name in enumerate(order):
            before = _numbers(table, states[i])[starts]
            y, _ = _means(x, gaps, means[name], before, missing)
            out[name] = y
            if name in steps:
                prior = np.append(np.nan, y[:-1])
                prior[starts] = before
                out[steps[name]] = y - prior
        return out

    heads = chunks.combine(chunks.summary(effect, ["_size", "_lead", "_trail", "_x1", *own]), join, ["_missing", *states])
    return chunks.finish(heads.select(*_KEYS, "_missing", *states), run, [*order, *steps.values()])


# Kalman smoother
def variances(t: np.ndarray, var: np.ndarray, q: float) -> np.ndarray:
    """Variance of the filtered state after t readings, without going through those before.

    Each reading maps p to var (p + q) / (p + q + var). With the fixed points of that map, r = (p - high) / (p - low) is multiplied by the same factor
    each time. The first reading leaves var / 2.
    """
    with np.errstate(divide="ignore", invalid="ignore"):
        if not q:
            return var / (t + 1)
        root = np.sqrt(q * q + 4 * q * var)
        high, low = 2 * q * var / (root + q), -(root + q) / 2
        factor, first = np.log1p(-(high - low) / (var - low)), (var / 2 - high) / (var / 2 - low)
        size = np.where(first > 0, np.log1p(-(high - low) / (var / 2 - low)), np.log(np.abs(first))) + np.where(t > 1, (t - 1) * factor, 0.0)
        p = np.where(first > 0, -(high - low * np.exp(size)) / np.expm1(size), (high + low * np.exp(size)) / (1 + np.exp(size)))
        return np.where(var > 0, p, 0.0)


def _gains(t: np.ndarray, total: np.ndarray, var: np.ndarray, q: float) -> tuple[np.ndarray, np.ndarray]:
    """Weight of the t-th reading in the filter, and of the state behind it in the smoother; of ``total`` readings."""
    after = variances(t, var, q)
    ahead = np.where(t > 1, variances(np.maximum(t - 1, 1), var, q) + q, var)
    with np.errstate(divide="ignore", invalid="ignore"):
        gain = np.where(ahead + var > 0, ahead / (ahead + var), 0.0)
        back = np.where((after + q > 0) & (t < total), after / (after + q), 0.0)
    return gain, back


def _scan(a: np.ndarray, b: np.ndarray, at: np.ndarray, state: np.ndarray | float) -> np.ndarray:
    """``affine_scan`` of groups that start at ``at``, each from its own state."""
    a, b = a.copy(), b.copy()
    b[at] += a[at] * state
    a[at] = 0
    return affine_scan(a, b)


def _scan_back(a: np.ndarray, b: np.ndarray, last: np.ndarray, state: np.ndarray | float) -> np.ndarray:
    """The same from the last rows to the first."""
    return _scan(a[::-1], b[::-1], len(a) - 1 - last, state)[::-1]


def kalman(df: DataFrame, stats: DataFrame, name: str, q: float = 1.0, cols: Cols = COLS, value: str | None = None, hours: int = CHUNK_HOURS) -> DataFrame:
    """Random-walk smoother of each sensor; observation noise and first variance are the train variance. ``stats``: sensor, mean, var.

    A missing value is the one before it, at the start the first one that there is. Sensors without statistics are left out.
    """
    source = value or cols.value
    chunks = Chunks(df, hours, cols)
    known = stats.filter(F.col(cols.sensor).isNotNull()).select(F.col(cols.sensor).cast("string").alias("_series"), F.col("mean").cast("double").alias("_mean"), F.col("var").cast("double").alias("_var"))

    def ends(table: pa.Table, starts: np.ndarray) -> dict[str, np.ndarray]:
        x = _numbers(table, source)
        gaps = _Gaps(x, starts)
        latest = np.where(gaps.lead < gaps.size, x[gaps.last - np.where(gaps.lead < gaps.size, gaps.trail, 0)], np.nan)
        return {"_size": gaps.size, "_x1": gaps.x1, "_latest": latest}

    def place(table: pa.Table, starts: np.ndarray) -> dict[str, np.ndarray]:
        size, x1, latest = (_numbers(table, n) for n in ("_size", "_x1", "_latest"))
        group, last = _groups(starts, len(size))
        ahead = np.cumsum(size) - size
        there = ~np.isnan(latest)
        at = np.append(-1, np.maximum.accumulate(np.where(there, np.arange(len(size)), -1))[:-1])
        first = np.full(len(starts), np.nan)
        at_first = np.flatnonzero(there)[::-1]
        first[group[at_first]] = x1[at_first]
        return {"_ahead": ahead - ahead[starts][group], "_total": np.add.reduceat(size, starts)[group], "_fill": np.where(at >= starts[group], latest[at], first[group])}

    def model(table: pa.Table, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Readings without gaps, gains of filter and smoother, last rows."""
        x = _numbers(table, source)
        gaps = _Gaps(x, starts)
        latest = np.maximum.accumulate(np.where(gaps.known, np.arange(len(x)), -1))
        y = np.where(gaps.leading, _numbers(table, "_fill"), x[np.maximum(latest, 0)])
        return y, *_gains(_numbers(table, "_ahead") + gaps.ahead + 1, _numbers(table, "_total"), _numbers(table, "_var"), q), gaps.last

    def effect(table: pa.Table, starts: np.ndarray) -> dict[str, np.ndarray]:
        y, gain, back, last = model(table, starts)
        zero = np.zeros_like(y)
        share, rest = _scan(1 - gain, zero, starts, 1.0), _scan(1 - gain, gain * y, starts, 0.0)
        out = {"_m_share": share[last], "_m_rest": rest[last]}
        smooth = {"_s_before": ((1 - back) * share, 0.0), "_s_after": (zero, 1.0), "_s_rest": ((1 - back) * rest, 0.0)}
        return out | {n: _scan_back(back, b, last, state)[starts] for n, (b, state) in smooth.items()}

    def join(table: pa.Table, starts: np.ndarray) -> dict[str, np.ndarray]:
        m_share, m_rest, before, after, rest, mean = (_numbers(table, n) for n in ("_m_share", "_m_rest", "_s_before", "_s_after", "_s_rest", "_mean"))
        last = _groups(starts, len(mean))[1]
        m = np.append(0.0, _scan(m_share, m_rest, starts, mean[starts])[:-1])
        m[starts] = mean[starts]
        s = np.append(_scan_back(after, before * m + rest, last, 0.0)[1:], 0.0)
        s[last] = 0.0  # nothing is behind the last row, whose weight back is 0
        return {"_before": m, "_after": s}

    def run(table: pa.Table, starts: np.ndarray) -> dict[str, np.ndarray]:
        y, gain, back, last = model(table, starts)
        m = _scan(1 - gain, gain * y, starts, _numbers(table, "_before")[starts])
        return {name: _scan_back(back, (1 - back) * m, last, _numbers(table, "_after")[last])}

    heads = chunks.combine(chunks.summary(ends, ["_size", "_x1", "_latest"]), place, ["_ahead", "_total", "_fill"]).join(known, "_series")
    heads = heads.select(*_KEYS, "_ahead", "_total", "_fill", "_mean", "_var")
    effects = chunks.summary(effect, ["_m_share", "_m_rest", "_s_before", "_s_after", "_s_rest"], heads)
    states = chunks.combine(effects.join(known.drop("_var"), "_series"), join, ["_before", "_after"]).select(*_KEYS, "_before", "_after")
    return chunks.finish(heads.join(states, list(_KEYS)), run, [name])
