"""SimHash near-duplicates by a segment-popcount embedding.

Every fingerprint is cut into 32 segments of two bits; the embedding is the vector of their bit counts, packed into one
long. One differing bit changes one count by one at most, so the Manhattan distance of two embeddings is a lower bound of
the Hamming distance of the fingerprints. The grid: the segments form ``bands`` bands; vectors at distance d or less agree
in at least ``bands - d`` of them, so each fingerprint goes to one cell for each choice of ``bands - d`` bands, and the
cells together hold every pair within that distance. Inside a cell the embedding bound, then the exact bits are tested.

Only distinct fingerprints are joined. A cell with more than ``CELL`` of them is split into chunks, and each pair of chunks
is a cell of its own, so no task holds a hot cell. A task emits one edge for each member of a group that it finds, not all
pairs. Components come from star contraction in Spark, with checkpoints in the shared folder.

Defined cases: a null, empty or wordless text has fingerprint zero, which is linked like any other; fewer words than a
shingle has are one shingle; repeated rows share their fingerprint. Ids may be of any type that has an order; a missing one
is no smallest id, and a component without any id has none. Other columns are left out.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut

SHINGLE = 3
SEED = 42
DISTANCE = 3
CELL = 1024
BROADCAST_ROWS = 1_000_000
_SEGMENTS = 32
_LOW_BITS = 0x5555555555555555


def shingle_hashes(text: str | None, shingle: int = SHINGLE) -> Iterator[np.ndarray]:
    """The hashes of a text's shingles, in order, in parts of at most 65,536; nothing for a text without words."""
    words = (text or "").encode().lower().split()
    if not words:
        return
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1]).tolist()
    ends = ends[min(shingle, len(words)) - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    for at in range(0, len(ends), 1 << 16):
        yield np.array([digest(joined[s:e], SEED) for s, e in zip(starts[at : at + (1 << 16)], ends[at : at + (1 << 16)], strict=False)], np.uint64)


def majority(parts: Iterable[np.ndarray]) -> int:
    """The unsigned 64-bit number whose bits are set in over half of the hashes; 0 for none."""
    ones, n = np.zeros(64, np.int64), 0
    for hashes in parts:
        n += len(hashes)
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return sum(1 << b for b in np.flatnonzero(2 * ones > n).tolist())


def hash_text(text: str | None, shingle: int = SHINGLE) -> int:
    """The fingerprint of a text."""
    return majority(shingle_hashes(text, shingle))


def _fingerprints(texts: pd.Series) -> pd.Series:
    return pd.Series(np.array([hash_text(t) for t in texts], np.uint64).view(np.int64))


def fingerprint(text: Column) -> Column:
    """The fingerprint as a signed long; ``lpad(lower(hex(..)), 16, '0')`` writes its bits."""
    return F.pandas_udf(_fingerprints, "long")(text)


def embed(fp: Column) -> Column:
    """32 counts of two bits each, packed: the embedding."""
    even, odd = fp.bitwiseAND(F.lit(_LOW_BITS)), F.shiftrightunsigned(fp, 1).bitwiseAND(F.lit(_LOW_BITS))
    return even.bitwiseXOR(odd).bitwiseOR(F.shiftleft(even.bitwiseAND(odd), 1))  # a sum that can't overflow


def embedding(fps: np.ndarray) -> np.ndarray:
    """``embed`` for an array of unsigned fingerprints."""
    return (fps & np.uint64(_LOW_BITS)) + ((fps >> np.uint64(1)) & np.uint64(_LOW_BITS))


def manhattan(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Manhattan distance of packed embeddings: |x - y| of two-bit counts, which are at most 2."""
    low, high = np.uint64(_LOW_BITS), np.uint64(_LOW_BITS << 1)
    one_a, two_a, one_b, two_b = a & low, (a & high) >> np.uint64(1), b & low, (b & high) >> np.uint64(1)
    apart = (one_a ^ one_b) | (two_a ^ two_b)
    by_two = (two_a & ~one_b & ~two_b & low) | (two_b & ~one_a & ~two_a & low)
    return np.bitwise_count(apart).astype(np.int64) + np.bitwise_count(by_two)


def bands_for(n: int) -> int:
    """Bands that keep the cells of n fingerprints small: more bands, longer keys. Any number finds every pair."""
    return 6 if n <= 1 << 26 else 8


def masks(bands: int, distance: int = DISTANCE) -> list[int]:
    """For each choice of ``bands - distance`` bands, the bits of their segments, as signed longs."""
    cuts = [round(i * _SEGMENTS / bands) for i in range(bands + 1)]
    bits = [sum(3 << 2 * s for s in range(a, b)) for a, b in zip(cuts, cuts[1:], strict=False)]
    whole = [sum(c) for c in combinations(bits, bands - distance)]
    return [m - (1 << 64) if m >> 63 else m for m in whole]


def links_in(nodes: np.ndarray, fps: np.ndarray, right: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """(smallest node, member) for what the links within these fingerprints connect.

    If some rows are on the right, only links between left and right rows count: the two chunks have cells of their own.
    """
    vectors = embedding(fps)
    a = np.flatnonzero(~right)
    b = np.flatnonzero(right) if right.any() else a
    near = manhattan(vectors[a][:, None], vectors[b]) <= distance
    near &= np.bitwise_count(fps[a][:, None] ^ fps[b]) <= distance
    label = nodes.copy()
    most = np.iinfo(np.int64).max
    while near.any():
        before = label.copy()
        label[b] = np.minimum(label[b], np.where(near, label[a][:, None], most).min(axis=0))
        label[a] = np.minimum(label[a], np.where(near, label[b], most).min(axis=1))
        if (before == label).all():
            break
    moved = label != nodes
    return label[moved], nodes[moved]


def _cell_edges(distance: int):
    """Edges of each cell; the rows come sorted by cell, and one cell at a time is held."""

    def edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []
        last = None
        made: list[tuple[np.ndarray, np.ndarray]] = []

        def close() -> None:
            node, fp, right = (np.concatenate(x) for x in zip(*held, strict=True))
            if len(node) > 1:
                made.append(links_in(node, fp.view(np.uint64), right, distance))
            held.clear()

        def batch_of() -> pa.RecordBatch:
            u, v = (np.concatenate([x[i] for x in made] or [np.zeros(0, np.int64)]) for i in (0, 1))
            made.clear()
            return pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], ["u", "v"])

        for batch in batches:
            cell, *rest = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(4))
            if not len(cell):
                continue
            cuts = [0, *(np.flatnonzero(cell[1:] != cell[:-1]) + 1).tolist(), len(cell)]
            for x, y in zip(cuts, cuts[1:], strict=False):
                if held and cell[x] != last:
                    close()
                last = cell[x]
                held.append([r[x:y] for r in rest])
            yield batch_of()
        if held:
            close()
        yield batch_of()

    return edges


def deal_cells(rows: DataFrame, keys: list[Column], by: Column, cell: int) -> DataFrame:
    """Rows of cells with their number of rows, n, plus ``_cell`` and ``_right``.

    A cell with more than ``cell`` rows is dealt into chunks by a hash of ``by``, and each pair of chunks is a cell of its own.
    """
    chunks = F.ceil(F.col("n") / cell).cast("int")
    own = F.pmod(F.xxhash64(by), chunks).cast("int")
    dealt = rows.withColumn("_own", own).withColumn("_other", F.explode(F.sequence(F.lit(0), chunks - 1)))
    dealt = dealt.withColumn("_cell", F.xxhash64(*keys, F.least("_own", "_other"), F.greatest("_own", "_other")))
    return dealt.withColumn("_right", F.col("_own") > F.col("_other"))


def link(fps: DataFrame, distance: int = DISTANCE, cell: int = CELL) -> DataFrame:
    """Edges u < v that connect what links of at most ``distance`` bits connect. fps: node, fp, each fingerprint once."""
    choices = masks(bands_for(fps.count()), distance)
    vector = embed(F.col("fp"))
    cells = fps.select("node", "fp", F.explode(F.array(*[F.struct(F.lit(i).alias("choice"), vector.bitwiseAND(F.lit(m)).alias("key")) for i, m in enumerate(choices)])).alias("c")).select("node", "fp", "c.*")
    full = cells.groupBy("choice", "key").agg(F.count("*").alias("n")).filter("n > 1")
    rows = deal_cells(cells.join(full, ["choice", "key"]), [F.col("choice"), F.col("key")], F.col("fp"), cell).select(F.col("_cell").alias("cell"), "node", "fp", F.col("_right").alias("right"))
    found = rows.repartition("cell").sortWithinPartitions("cell").mapInArrow(_cell_edges(distance), "u long, v long")
    return cut(found.distinct())  # read more than once


def _stars(edges: DataFrame, large: bool) -> DataFrame:
    """One star contraction. edges: u < v. Large: both directions count as neighbours; small: only the smaller ones."""
    both = edges.select(F.col("u").alias("a"), F.col("v").alias("b"))
    back = edges.select(F.col("v").alias("a"), F.col("u").alias("b"))
    near = both.unionByName(back) if large else back
    least = near.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("hub"), F.least("a", "m").alias("m"))
    met = near.join(least, near["a"] == least["hub"])
    if large:
        out = met.filter("b > a").select(F.col("m").alias("x"), F.col("b").alias("y"))
    else:
        out = met.select(F.col("m").alias("x"), F.col("b").alias("y")).unionByName(least.select(F.col("m").alias("x"), F.col("hub").alias("y")))
    return out.filter("x <> y").select(F.least("x", "y").alias("u"), F.greatest("x", "y").alias("v")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """node, component (the smallest node that it is connected to) for every node of an edge, smallest nodes left out."""
    mark = lambda e: tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
    now, seen = edges, None
    while True:
        now = cut(_stars(_stars(now, True), False))
        if (new := mark(now)) == seen:
            break
        seen = new
    return now.select(F.col("v").alias("node"), F.col("u").alias("component"))


def row_of(id_col: str, text_col: str) -> Column:
    """What orders rows in a group: whether the id is missing, the id, a hash of the text."""
    return F.struct(F.col(id_col).isNull().alias("no_id"), F.col(id_col).alias("id"), F.xxhash64(text_col).alias("mark"))


def groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", distance: int = DISTANCE, cell: int = CELL) -> tuple[DataFrame, DataFrame]:
    """node (the fingerprint), row of every document row, and node, component of the fingerprints that are linked."""
    known = cut(docs.select(row_of(id_col, text_col).alias("row"), fingerprint(F.col(text_col)).alias("node")))
    fps = known.groupBy("node").agg(F.first("node").alias("fp"))
    return known, components(link(cut(fps), distance, cell))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", distance: int = DISTANCE, cell: int = CELL) -> DataFrame:
    """One row per document row: id, fp (signed long), fingerprint (16 hex digits), component_id."""
    known, linked = groups(docs, id_col, text_col, distance, cell)
    least = known.groupBy("node").agg(F.min("row.id").alias("least")).join(linked, "node", "left").select("node", "least", F.coalesce("component", "node").alias("component"))
    least = cut(least)
    first = least.groupBy("component").agg(F.min("least").alias("component_id"))
    hexed = F.lpad(F.lower(F.hex("node")), 16, "0")
    met = known.join(least.join(first, "component").select("node", "component_id"), "node")
    return met.select(F.col("row.id").alias(id_col), F.col("node").alias("fp"), hexed.alias("fingerprint"), "component_id")


def small(df: DataFrame) -> DataFrame:
    """Broadcast if it has at most BROADCAST_ROWS rows: else what it is joined with is shuffled once."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def keep_first(docs: DataFrame, known: DataFrame, linked: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The first row of each group, all columns kept: that with the smallest id, a missing one counting as the largest, then with the smallest hash of its text; of repeated rows one."""
    rows = known.groupBy("node", "row").agg(F.count("*").alias("times")).join(linked, "node", "left").select("row", "times", F.coalesce("component", "node").alias("component"))
    rows = cut(rows)
    first = rows.groupBy("component").agg(F.min("row").alias("first"))
    marked = rows.join(first, "component").select("row.id", "row.mark", (F.col("row") == F.col("first")).alias("kept"), "times")
    # Most rows are neither gone nor repeated, and are not moved for either.
    odd = small(cut(marked.filter("NOT kept OR times > 1").select(F.col("id").alias("_odd_id"), F.col("mark").alias("_odd_mark"), "kept")))
    same = docs[id_col].eqNullSafe(odd["_odd_id"]) & (F.xxhash64(docs[text_col]) == odd["_odd_mark"])
    single = docs.join(odd, same, "left_anti")
    repeated = docs.join(odd.filter(odd["kept"]), same, "left_semi")
    return single.unionByName(repeated.withColumn("_mark_of_text", F.xxhash64(text_col)).dropDuplicates([id_col, "_mark_of_text"]).drop("_mark_of_text"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", distance: int = DISTANCE, cell: int = CELL) -> DataFrame:
    """The first document of each component, see ``keep_first``."""
    return keep_first(docs, *groups(docs, id_col, text_col, distance, cell), id_col, text_col)
