"""Benchmark decontamination: Wu-Manber multi-pattern search over words.

Patterns are the windows of ``window`` consecutive words of the benchmark items (a shorter item is one pattern). A block
is up to three adjacent words. The shift table says, for the block that ends at the current word, how many words may be
skipped because no pattern can end there; where it says 0, the patterns in the bucket of that block are compared directly.

The benchmark is a stated query set: the driver takes it in blocks of at most ``max_patterns`` patterns, one broadcast
each, and every block is searched in all documents, ``BLOCKS`` of them in a pass. Documents are never shuffled.

Defined cases: a null or empty document has no words and no hit; a null or wordless item has no pattern; the words of an
item without an id are hits, but it cannot be listed and is not counted; an item repeated under one id counts once; repeated
document rows are judged one by one. Other columns are left out.
"""

from __future__ import annotations

import uuid
from collections import defaultdict
from collections.abc import Iterable, Iterator, Sequence
from itertools import islice

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut

WINDOW = 13
#: Blocks of patterns that are searched in one pass over the documents.
BLOCKS = 2
#: Bytes of words stay (A-Z in lower case), all others part words.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if c > 127 or 97 <= c <= 122 or 48 <= c <= 57 else 32 for c in range(256))

Pattern = tuple[bytes, ...]


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(_FOLD).split()


def patterns_of(text: str | None, window: int = WINDOW) -> Iterator[Pattern]:
    words = words_of(text)
    if words:
        for i in range(max(1, len(words) - window + 1)):
            yield tuple(words[i : i + window])


class WuManber:
    """Search for word patterns of one length."""

    def __init__(self, patterns: Iterable[Pattern]):
        self.patterns = set(patterns)
        self.length = m = len(next(iter(self.patterns)))
        self.block = b = min(3, m)
        self.default = m - b + 1
        self.shift: dict[Pattern, int] = {}
        self.buckets: dict[Pattern, list[Pattern]] = defaultdict(list)
        for p in self.patterns:
            for j in range(b, m + 1):
                key = p[j - b : j]
                self.shift[key] = min(self.shift.get(key, m), m - j)
            self.buckets[p[m - b :]].append(p)

    def find(self, words: list[bytes]) -> Iterator[tuple[int, Pattern]]:
        """Start and pattern of every occurrence, in order."""
        m, b, shift, default = self.length, self.block, self.shift, self.default
        blocks = words if b == 1 else list(zip(*(words[k:] for k in range(b)), strict=False))  # the block at i ends at word i + b - 1
        i, n = m - b, len(words) - b
        while i <= n:
            key = (blocks[i],) if b == 1 else blocks[i]
            skip = shift.get(key, default)
            if skip:
                i += skip
                continue
            start = i + b - m
            for p in self.buckets[key]:
                if words[start] == p[0] and tuple(words[start : start + m]) == p:
                    yield start, p
            i += 1


class Searcher:
    """One Wu-Manber automaton for each pattern length of a block of patterns."""

    def __init__(self, items: dict[Pattern, list[str]]):
        self.items = items
        by_length: dict[int, list[Pattern]] = defaultdict(list)
        for p in items:
            by_length[len(p)].append(p)
        self.parts = [WuManber(ps) for _, ps in sorted(by_length.items())]

    def search(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """Merged word spans (end exclusive) that occurrences cover, and the items with occurring patterns."""
        found, items = [], set()
        for part in self.parts:
            for start, p in part.find(words):
                found.append((start, start + part.length))
                items.update(self.items[p])
        spans: list[tuple[int, int]] = []
        for s, e in sorted(found):
            if spans and s <= spans[-1][1]:
                spans[-1] = (spans[-1][0], max(e, spans[-1][1]))
            else:
                spans.append((s, e))
        return spans, items


def pattern_blocks(benchmark: DataFrame, window: int, max_patterns: int, id_col: str, text_col: str) -> Iterator[dict[Pattern, list[str]]]:
    """Patterns with their items, in blocks; one item may be in two blocks."""
    block: dict[Pattern, set[str]] = defaultdict(set)
    for item, text in benchmark.select(F.col(id_col).cast("string"), text_col).toLocalIterator():
        for p in patterns_of(text, window):
            block[p].update(() if item is None else (item,))
            if len(block) >= max_patterns:
                yield {k: sorted(v) for k, v in block.items()}
                block.clear()
    if block:
        yield {k: sorted(v) for k, v in block.items()}


_SPANS = "array<struct<s: long, e: long>>"


def _covered(spans: Column) -> Column:
    """Words covered by spans that may overlap."""
    start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("end"))
    return F.aggregate(F.array_sort(spans), start, lambda a, x: F.struct((a["n"] + F.greatest(F.lit(0), x["e"] - F.greatest(a["end"], x["s"]))).alias("n"), F.greatest(a["end"], x["e"]).alias("end")))["n"]


def _searcher(docs: DataFrame, blocks: Sequence[dict[Pattern, list[str]]], text: Column) -> Column:
    """A struct n_words, spans, items for some blocks of patterns; each text is split into words once."""
    held = [docs.sparkSession.sparkContext.broadcast(Searcher(b)) for b in blocks]

    def search(texts: pd.Series) -> pd.DataFrame:
        rows = []
        for t in texts:
            words, spans, items = words_of(t), [], set()
            for block in held:
                more, named = block.value.search(words)
                spans += more
                items |= named
            rows.append((len(words), [{"s": s, "e": e} for s, e in spans], sorted(items)))
        return pd.DataFrame(rows, columns=["n_words", "spans", "items"])

    return F.pandas_udf(search, f"n_words long, spans {_SPANS}, items array<string>")(text)


def _searched(docs: DataFrame, benchmark: DataFrame, text_col: str, window: int, max_patterns: int, item_col: str, item_text_col: str) -> tuple[DataFrame, list[str]]:
    """Documents with a struct n_words, spans, items for each pass, and the names of these columns.

    A pass takes ``BLOCKS`` blocks, so that a worker holds no more of the benchmark; between passes the documents are written.
    """
    mark, names = uuid.uuid4().hex, []
    blocks = pattern_blocks(benchmark, window, max_patterns, item_col, item_text_col)
    while (some := list(islice(blocks, BLOCKS))) or not names:
        docs = cut(docs) if names else docs
        names.append(f"_{mark}_{len(names)}")
        docs = docs.withColumn(names[-1], _searcher(docs, some or [{}], F.col(text_col)))
    return docs, names


def _is_contaminated(n_words: Column, n_hit: Column, share: int) -> Column:
    return (n_hit > 0) & (n_hit * share >= n_words)


def keep_clean(
    docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, share: int = 20, max_patterns: int = 500_000, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text"
) -> DataFrame:
    """The documents of whose words less than a ``share``-th is hit, all columns kept."""
    found, names = _searched(docs, benchmark, text_col, window, max_patterns, item_col, item_text_col)
    bad = _is_contaminated(F.col(names[0])["n_words"], _covered(F.concat(*[F.col(n)["spans"] for n in names])), share)
    return found.filter(~bad).drop(*names)


def decontaminate(
    docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, share: int = 20, max_patterns: int = 500_000, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text"
) -> DataFrame:
    """One row per document row: id, n_words, n_hit, n_items, items (sorted as strings), spans (of words), contaminated (at least a ``share``-th of its words hit)."""
    found, names = _searched(docs.select(F.col(id_col), F.col(text_col).alias("_text")), benchmark, "_text", window, max_patterns, item_col, item_text_col)
    each = lambda field: [F.col(n)[field] for n in names]
    out = found.select(
        id_col, F.col(names[0])["n_words"].alias("n_words"), F.concat(*each("spans")).alias("spans"), F.array_sort(F.array_distinct(F.concat(*each("items")))).alias("items")
    )
    n_hit = _covered(F.col("spans"))
    return out.select(
        id_col, "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), "items", "spans", _is_contaminated(F.col("n_words"), n_hit, share).alias("contaminated")
    )
