"""SimHash near-duplicates by Jaccard similarity, for the pipeline.

A text is the set of hashes of its five-word shingles; fewer words are one shingle. Texts of equal sets are one node. Links
are pairs of sets with a Jaccard similarity of 0.8 or more. Candidates come from operator 6's popcount grid over the
fingerprints of the sets, with its three bits (``grid_pairs``). Pairs at 0.8 differ in some 10 of 64 bits, and no grid over
popcounts can hold such a distance (see the README), so cells of MinHash add those beyond: the minima of 24 x 4 hash functions
give each node 24 cells; two sets of similarity s share none with probability (1 - s^4)^24: 3e-6 at 0.8, less above. Inside
the cells work the popcount bound and the bits of the fingerprints. The exact comparison of whole sets decides for both.

First each node is compared with what the grid links it to, and with one node of each of its cells, that with the most company:
what is a copy of one text meets that text. Then the nodes of a cell that are still apart are compared in numpy, inside tasks that hold ``CELL`` nodes or two
times as many: by the popcount bound and the bits (``DISTANCE``, five deviations beyond those of 0.8), then by their
``SKETCH`` smallest hashes. These are the whole set of most texts, so the similarity is known; for longer sets it is estimated
(``LIKELY``: at 0.8 all but 2e-4 look so similar). Only what passes reaches the exact comparison, so a large group of near
copies makes no square of rows.

Defined cases: wordless texts are one group. Which row of a group stays is as in ``simhash.keep_first``.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut
from .simhash import CELL, components, deal_cells, embedding, keep_first, link, majority, manhattan, row_of, small
from .simhash import shingle_hashes as hashes_of

SHINGLE = 5
SIMILARITY = 0.8
LIKELY, SURE = 0.71, 0.79
DISTANCE = 24
SKETCH = 256
BANDS, ROWS = 24, 4
SEED = 42
_SLICE = 1 << 12
_rng = np.random.default_rng(SEED)
_MASKS, _FACTORS = _rng.integers(0, 1 << 64, (2, BANDS * ROWS, 1), np.uint64)
_FACTORS |= np.uint64(1)


def shingle_hashes(text: str | None, shingle: int = SHINGLE) -> np.ndarray:
    """The distinct hashes of a text's shingles, in order."""
    return np.unique(np.concatenate([np.zeros(0, np.uint64), *hashes_of(text, shingle)]))


def minima(hashes: np.ndarray) -> np.ndarray:
    """The least value of each hash function over a set that is not empty."""
    return np.min([((hashes[at : at + _SLICE] ^ _MASKS) * _FACTORS).min(axis=1) for at in range(0, len(hashes), _SLICE)], axis=0)


def band_keys(least: np.ndarray) -> list[int]:
    """One signed long a band."""
    return [xxhash.xxh64_intdigest(b.tobytes(), i) - (1 << 63) for i, b in enumerate(least.reshape(BANDS, ROWS))]


def _keys(texts: pd.Series) -> pd.DataFrame:
    same, bands, fps = [], [], []
    for t in texts:
        s = shingle_hashes(t)
        same.append(xxhash.xxh128_digest(s.tobytes()))
        bands.append(band_keys(minima(s)) if len(s) else [])
        fps.append(majority([s]))
    return pd.DataFrame({"node": same, "bands": bands, "fp": np.array(fps, np.uint64).view(np.int64)})


def _sets(texts: pd.Series) -> pd.DataFrame:
    sets = [shingle_hashes(t) for t in texts]
    return pd.DataFrame({"node": [xxhash.xxh128_digest(s.tobytes()) for s in sets], "hashes": [s.view(np.int64) for s in sets]})


def sketch_of(hashes: np.ndarray) -> np.ndarray:
    """The SKETCH smallest 32-bit heads of a set of hashes; fewer if the set has fewer."""
    return np.unique((hashes >> np.uint64(32)).astype(np.uint32))[:SKETCH]


def _sketches(texts: pd.Series) -> pd.DataFrame:
    sets = [shingle_hashes(t) for t in texts]
    return pd.DataFrame({"node": [xxhash.xxh128_digest(s.tobytes()) for s in sets], "sketch": [sketch_of(s).tobytes() for s in sets]})


def _of_nodes(wanted: DataFrame, texts: DataFrame, nodes: DataFrame, fn: Callable, column: str) -> DataFrame:
    """node and a column that ``fn`` makes of its text, for the nodes that are wanted: one text of each is hashed again."""
    asked = small(cut(wanted.join(nodes, "node").select(F.col("row.id").alias("_id"), F.col("row.mark").alias("_mark"))))
    made = F.pandas_udf(fn, f"node binary, {column}").asNondeterministic()  # else a null check of it moves before the join, to all texts
    own = texts["_row"]
    met = texts.join(asked, own["id"].eqNullSafe(asked["_id"]) & (own["mark"] == asked["_mark"]), "left_semi")
    return cut(met.select(made("_text").alias("_s")).select("_s.*").dropDuplicates(["node"]))


def _similar(pairs: DataFrame, texts: DataFrame, nodes: DataFrame, similarity: float) -> DataFrame:
    """The pairs u < v whose sets are that similar. texts: _row, _text; nodes: node, row."""
    sets = _of_nodes(pairs.select(F.explode(F.array("u", "v")).alias("node")).distinct(), texts, nodes, _sets, "hashes array<long>")
    both: Column = F.size(F.array_intersect("_a", "_b"))
    joined = pairs.join(sets.toDF("u", "_a"), "u").join(sets.toDF("v", "_b"), "v")
    counted = joined.select("u", "v", both.alias("_both"), (F.size("_a") + F.size("_b")).alias("_all"))
    return cut(counted.filter(F.col("_both") / (F.col("_all") - F.col("_both")) >= similarity).select("u", "v").distinct())


def _ordered(pairs: DataFrame) -> DataFrame:
    return pairs.filter("x <> y").select(F.least("x", "y").alias("u"), F.greatest("x", "y").alias("v")).distinct()


def likely_pairs(root: np.ndarray, major: np.ndarray, fps: np.ndarray, sketches: list[np.ndarray], right: np.ndarray, distance: int = DISTANCE) -> tuple[np.ndarray, np.ndarray]:
    """Positions of pairs of different roots that are or may be similar; one of each pair is not of the major root.

    If some rows are on the right, only pairs of a left and a right row count.
    """
    a, b, split = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], bool(right.any())
    sizes = np.array([len(s) for s in sketches])
    starts, values = np.cumsum(sizes) - sizes, np.concatenate(sketches)
    known, code = np.unique(values, return_inverse=True)
    held, whole = np.zeros(len(known), bool), sizes < SKETCH
    top = np.where(whole, np.uint64(1 << 32), values[starts + sizes - 1].astype(np.uint64))  # all of a set up to here is known
    vectors = embedding(fps)
    for i in np.flatnonzero(root != major).tolist():
        near = (manhattan(vectors, vectors[i]) <= distance) & (root != root[i])
        if split:
            near &= right != right[i]
        near[:i] &= root[:i] == major[:i]  # a pair of two minor rows comes once
        at = np.flatnonzero(near)
        at = at[np.bitwise_count(fps[at] ^ fps[i]) <= distance]
        if not len(at):
            continue
        own = slice(starts[i], starts[i] + sizes[i])
        held[code[own]] = True
        both = np.add.reduceat(held[code], starts, dtype=np.int64)[at]
        held[code[own]] = False
        of_i = np.searchsorted(values[own], top[at], "right")
        of_j = np.where(top[at] <= top[i], sizes[at], np.add.reduceat(values <= top[i], starts, dtype=np.int64)[at])
        at = at[both >= np.where(whole[i] & whole[at], SURE, LIKELY) * (of_i + of_j - both)]
        a.append(np.full(len(at), i))
        b.append(at)
    return np.concatenate(a), np.concatenate(b)


def _likely(distance: int):
    """Likely pairs of each cell; the rows come sorted by cell, and one cell at a time is held."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        last = None

        def close() -> pa.RecordBatch:
            node, root, major, fp, sketch, right = zip(*held, strict=True)
            known = {r: i for i, r in enumerate(dict.fromkeys((*root, *major)))}
            number = lambda rows: np.array([known[r] for r in rows])
            sets = [np.frombuffer(x, np.uint32) for x in sketch]
            a, b = likely_pairs(number(root), number(major), np.array(fp, np.int64).view(np.uint64), sets, np.array(right), distance)
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array([node[i] for i in x.tolist()], pa.binary()) for x in (a, b)], ["x", "y"])

        for batch in batches:
            for cell, *row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if held and cell != last:
                    yield close()
                last = cell
                held.append(tuple(row))
        if held:
            yield close()

    return run


def grid_pairs(nodes: DataFrame, cell: int = CELL) -> DataFrame:
    """Pairs x, y of nodes that connect those within operator 6's three bits: its popcount grid over the different fingerprints. nodes: node, fp."""
    firsts = cut(nodes.groupBy("fp").agg(F.min("node").alias("node")))
    edges = link(firsts.select(F.col("fp").alias("node"), "fp"), cell=cell)
    of = lambda x: firsts.select(F.col("fp").alias(x), F.col("node").alias(f"_{x}"))
    near = edges.join(of("u"), "u").join(of("v"), "v").select(F.col("_u").alias("x"), F.col("_v").alias("y"))
    same = nodes.select("fp", "node").join(firsts.select("fp", F.col("node").alias("x")), "fp").filter("x <> node")
    return near.unionByName(same.select("x", F.col("node").alias("y")))


def groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY, cell: int = CELL) -> tuple[DataFrame, DataFrame]:
    """node (the digest of the set), row of every document row, and node, component of nodes that are linked.

    ``similarity`` may be higher than 0.8; below, candidates would be missed.
    """
    texts = docs.select(row_of(id_col, text_col).alias("_row"), F.col(text_col).alias("_text"))
    known = cut(texts.select("_row", F.pandas_udf(_keys, "node binary, bands array<long>, fp long")("_text").alias("_k")).select("_row", "_k.*"))
    nodes = cut(known.groupBy("node").agg(F.min("_row").alias("row"), *[F.first(c).alias(c) for c in ("bands", "fp")]))
    cells = nodes.select("node", F.explode("bands").alias("cell"))
    full = cells.groupBy("cell").agg(F.count("*").alias("n")).filter("n > 1")
    shared = cut(cells.join(full, "cell"))
    company = shared.groupBy("node").agg(F.sum("n").alias("company"))
    hubs = shared.join(company, "node").groupBy("cell").agg(F.max_by("node", F.struct("company", "node")).alias("hub"))
    met = shared.join(hubs, "cell").select(F.col("hub").alias("x"), F.col("node").alias("y"))
    first = cut(_ordered(grid_pairs(nodes, cell).unionByName(met)))
    linked = _similar(first, texts, nodes, similarity)
    rooted = shared.join(components(linked), "node", "left").select("cell", "node", "n", F.coalesce("component", "node").alias("root"))
    sizes = rooted.groupBy("cell", "root").agg(F.count("*").alias("_n"))
    mixed = sizes.groupBy("cell").agg(F.count("*").alias("roots"), F.max_by("root", F.struct("_n", "root")).alias("major")).filter("roots > 1").drop("roots")
    left = cut(rooted.join(mixed, "cell").join(nodes.select("node", "fp"), "node"))
    left = left.join(_of_nodes(left.select("node").distinct(), texts, nodes, _sketches, "sketch binary"), "node")
    rows = deal_cells(left, [F.col("cell")], F.col("node"), cell).select("_cell", "node", "root", "major", "fp", "sketch", "_right")
    more = rows.repartition("_cell").sortWithinPartitions("_cell").mapInArrow(_likely(DISTANCE), "x binary, y binary")
    rest = cut(_ordered(more).join(first, ["u", "v"], "left_anti"))
    return known.select("node", F.col("_row").alias("row")), components(cut(linked.unionByName(_similar(rest, texts, nodes, similarity))))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY, cell: int = CELL) -> DataFrame:
    """The first document of each group, all columns kept."""
    return keep_first(docs, *groups(docs, id_col, text_col, similarity, cell), id_col, text_col)
