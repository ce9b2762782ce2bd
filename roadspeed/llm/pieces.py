"""SentencePiece encoding and decoding, giant documents by a max-plus parallel scan.

Documents of ordinary length go to the public library as they are. A giant document is split into chunks at fixed places.
The states of a cut are the tokens that may stand there. Each chunk yields its transfer matrix: for every state at its start
and its end the best score of the tokens between (-inf: none). Matrices are combined associatively (max-plus product), first
inside blocks of chunks, then over the blocks of a document; the states at all cuts follow, and each chunk is backtraced
independently between its two states.

All pieces of the vocabulary compete. In a unigram model they have their scores, and a state is how many characters the token
that straddles a cut reaches into the next chunk. Byte-pair merges leave no two tokens side by side that they would have
merged otherwise, and any tokens of which each neighbouring pair is left as it is are the result of the merges. So each pair
of neighbours has a score of 0 or -inf, and a state is a token that covers the character before the cut. No piece holds some
pairs of characters; no token crosses there, so the paths between two such places do not depend on what is around them.

Defined cases: a null or empty text has no tokens and decodes to ""; repeated rows have equal tokens; U+2581 in a text
decodes to a blank, as in the library. Models need byte fallback. Other columns are left out but for those named in ``keep``.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import chain, pairwise

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute  # noqa: F401
import sentencepiece
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
#: Characters from which a document is giant (two chunks or more), those of one chunk, and chunks of one block.
GIANT, CHUNK, BLOCK = 32_768, 16_384, 64
SPACE = "▁"
#: Fixed value: what the public library takes off the lowest score for a character without a piece.
_UNKNOWN_PENALTY = 10.0
#: Pairs of tokens and short stretches that a worker remembers.
_KEPT = 100_000

Edge = tuple[int, int, tuple[int, ...], float]


def _fields(data: bytes) -> Iterator[tuple[int, int, int, object]]:
    """Field number, start, end and value of the fields of a protocol-buffer message."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            value |= (data[at] & 127) << shift
            at, shift = at + 1, shift + 7
            if data[at - 1] < 128:
                return value

    while at < len(data):
        start, tag = at, varint()
        if tag & 7 == 0:
            value: object = varint()
        elif tag & 7 == 2:
            n = varint()
            value, at = data[at : at + n], at + n
        else:
            n = 8 if tag & 7 == 1 else 4
            value, at = data[at : at + n], at + n
        yield tag >> 3, start, at, value


def model_type(proto: bytes) -> int:
    """1: unigram, 2: byte-pair merges (field 3 of the trainer settings, which are field 2)."""
    settings = next((v for k, _, _, v in _fields(proto) if k == 2), b"")
    return next((v for k, _, _, v in _fields(settings) if k == 3), 1)


class Pieces:
    """A model file with what the scan needs to know of it."""

    def __init__(self, proto: bytes):
        self.sp = sp = sentencepiece.SentencePieceProcessor(model_proto=proto)
        self.merges = model_type(proto) == 2
        plain = [(sp.id_to_piece(i), i) for i in range(sp.get_piece_size()) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))]
        self.ids = dict(plain)
        self.bytes = {sp.piece_to_id(f"<0x{b:02X}>"): b for b in range(256) if sp.is_byte(sp.piece_to_id(f"<0x{b:02X}>"))}
        self.byte_ids = {b: i for i, b in self.bytes.items()}
        if len(self.bytes) < 256:
            raise ValueError("the model has no byte fallback")
        self.scores = {p: sp.get_score(i) for p, i in plain}
        self.reach = max(map(len, self.ids), default=1)
        self.unknown = min(self.scores.values(), default=0.0) - _UNKNOWN_PENALTY
        self.pairs = {p[i : i + 2] for p in self.ids for i in range(len(p) - 1)}
        self.pair_codes = np.array(sorted(ord(x[0]) << 21 | ord(x[1]) for x in self.pairs), np.int64)
        self.left_alone: dict[tuple[str, str], bool] = {}
        self.stretches: dict[str, tuple[int, ...]] = {}

    def edges(self, text: str, lead: int, n: int) -> Iterator[Edge]:
        """Tokens of a unigram model that start in the n characters behind ``lead``: start, end (from ``lead`` on), ids, score; in order of start."""
        for i in range(n):
            single = False
            for size in range(1, min(self.reach, len(text) - lead - i) + 1):
                piece = text[lead + i : lead + i + size]
                if (number := self.ids.get(piece)) is not None:
                    single |= size == 1
                    yield i, i + size, (number,), self.scores[piece]
            if not single:
                yield i, i + 1, tuple(self.byte_ids[b] for b in text[lead + i].encode()), self.unknown

    def chunks(self, text: str, size: int) -> Iterator[tuple[int, int, int, str]]:
        """Number, lead, length and text (with what is around it as far as a token may reach) of each chunk of a normalised text."""
        count = max(1, len(text) // max(size, self.reach + 1))
        for k in range(count):
            a, b = len(text) * k // count, len(text) * (k + 1) // count
            left = max(0, a - self.reach)
            yield k, a - left, b - a, text[left : b + self.reach]

    def merged(self, text: str) -> list[str]:
        """The tokens that the merges leave of a short text: the best piece first, the leftmost of equal ones."""
        parts = list(text)
        while True:
            best, at = None, 0
            for i in range(len(parts) - 1):
                score = self.scores.get(parts[i] + parts[i + 1])
                if score is not None and (best is None or score > best):
                    best, at = score, i
            if best is None:
                return parts
            parts[at : at + 2] = [parts[at] + parts[at + 1]]

    def alone(self, before: str, piece: str) -> bool:
        """Whether the merges leave two neighbours, or with nothing before a piece, as they are."""
        key = (before, piece)
        known = self.left_alone.get(key)
        if known is None:
            if len(self.left_alone) > _KEPT:
                self.left_alone.clear()
            known = self.left_alone[key] = self.merged(before + piece) == [x for x in key if x]
        return known

    def safe(self, text: str, at: int) -> bool:
        """Whether no token can cross a place."""
        return not 0 < at < len(text) or text[at - 1 : at + 1] not in self.pairs

    def stretches_of(self, text: str) -> list[str]:
        """A text cut at all places that no token can cross."""
        codes = np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.int64)
        pairs = codes[:-1] << 21 | codes[1:]
        near = np.searchsorted(self.pair_codes, pairs)
        held = np.append(self.pair_codes, -1)[near] == pairs
        places = [0, *(np.flatnonzero(~held) + 1).tolist(), len(text)]
        return [text[a:b] for a, b in pairwise(places)]

    def cover(self, text: str, at: int) -> list[tuple[int, str]]:
        """The states of a cut: end and piece of the tokens that hold the character before it; one without a piece where none can cross."""
        if self.safe(text, at):
            return [(at, "")]
        out = []
        for a in range(max(0, at - self.reach), at):
            for e in range(at, min(len(text), a + self.reach) + 1):
                if (piece := text[a:e]) in self.ids and self.alone("", piece) or e - a == 1:
                    out.append((e, piece))
        return out

    def flow(self, text: str, sources: list[tuple[int, str, int]], end: int) -> dict[int, dict[str, tuple[int, str]]]:
        """By place, then by the token that ends there: the sources (bits) that reach it, and a token before it. Sources: place, token before it, bit."""
        seen: dict[int, dict[str, tuple[int, str]]] = {}
        for at, piece, bit in sources:
            held = seen.setdefault(at, {})
            held[piece] = (held.get(piece, (0, ""))[0] | bit, "")
        for at in range(min(seen), end):
            if not (here := seen.get(at)):
                continue
            for size in range(1, min(self.reach, end - at) + 1):
                piece = text[at : at + size]
                if size > 1 and (piece not in self.ids or not self.alone("", piece)):
                    continue
                for before, (bits, _) in here.items():
                    if not before or self.alone(before, piece):
                        ahead = seen.setdefault(at + size, {})
                        known = ahead.get(piece)
                        ahead[piece] = (bits | known[0], known[1]) if known else (bits, before)
        return seen

    def path(self, text: str, at: int, before: str, end: int, last: str = "") -> list[str]:
        """Tokens from a place to another one, behind ``before``; the last one is given, or any."""
        if at == end:
            return []
        seen = self.flow(text, [(at, before, 1)], end)
        piece, out = last or next(iter(seen[end])), []
        while end > at:
            out.append(piece)
            end, piece = end - len(piece), seen[end][piece][1]
        return out[::-1]

    def number(self, piece: str) -> tuple[int, ...]:
        known = self.ids.get(piece)
        return (known,) if known is not None else tuple(self.byte_ids[b] for b in piece.encode())

    def stretch(self, text: str) -> tuple[int, ...]:
        """Ids of a text that no token crosses at its ends nor can be cut inside."""
        known = self.stretches.get(text)
        if known is None:
            known = tuple(chain.from_iterable(map(self.number, self.path(text, 0, "", len(text)))))
            if len(text) < 64:
                if len(self.stretches) > _KEPT:
                    self.stretches.clear()
                self.stretches[text] = known
        return known

    def _inside(self, text: str, a: int, b: int) -> tuple[int, int] | None:
        """The first and the last place between a and b that no token can cross."""
        first = next((i for i in range(a, b + 1) if self.safe(text, i)), None)
        return None if first is None else (first, next(i for i in range(b, first - 1, -1) if self.safe(text, i)))

    def merge_transfer(self, text: str, lead: int, n: int) -> np.ndarray:
        """``transfer`` for merges: 0 where tokens lead from a state to another, else -inf."""
        left, right = self.cover(text, lead), self.cover(text, lead + n)
        sources = [(e, piece, 1 << i) for i, (e, piece) in enumerate(left)]
        out = np.full((len(left), len(right)), -np.inf)
        if safe := self._inside(text, lead, lead + n):
            into = self.flow(text, sources, safe[0]).get(safe[0], {})
            reached = np.array([any(bits >> i & 1 for bits, _ in into.values()) for i in range(len(left))])
            ahead = self.flow(text, [(safe[1], "", 1)], max(e for e, _ in right))
            ends = np.array([piece in ahead.get(e, {}) or not piece for e, piece in right])
            out[np.ix_(reached, ends)] = 0
        else:
            ahead = self.flow(text, sources, max(e for e, _ in right))
            for j, (e, piece) in enumerate(right):
                bits = ahead.get(e, {}).get(piece, (0, ""))[0]
                out[[i for i in range(len(left)) if bits >> i & 1], j] = 0
        return out

    def merge_trace(self, text: str, lead: int, n: int, start: int, end: int) -> list[int]:
        """``trace`` for merges: the tokens behind the one of the first state, with that of the second."""
        at, before = self.cover(text, lead)[start]
        to, last = self.cover(text, lead + n)[end]
        out: list[int] = []
        safe = self._inside(text, at, to - len(last))
        first, final = safe or (to, to)
        for piece in self.path(text, at, before, first, "" if safe else last):
            out += self.number(piece)
        if safe:
            for stretch in self.stretches_of(text[first:final]) if first < final else ():
                out += self.stretches.get(stretch) or self.stretch(stretch)
            for piece in self.path(text, final, "", to, last):
                out += self.number(piece)
        return out

    def transfer(self, text: str, lead: int, n: int) -> np.ndarray:
        """Best score from each state at the start to each state at the end of a chunk."""
        if self.merges:
            return self.merge_transfer(text, lead, n)
        best = np.full((n + self.reach, self.reach), -np.inf)
        best[np.arange(self.reach), np.arange(self.reach)] = 0
        for s, e, _, score in self.edges(text, lead, n):
            np.maximum(best[e], best[s] + score, out=best[e])
        return best[n:].T.copy()

    def trace(self, text: str, lead: int, n: int, start: int, end: int) -> list[int]:
        """Ids of the best path between two states."""
        if self.merges:
            return self.merge_trace(text, lead, n, start, end)
        best, back = [-np.inf] * (n + self.reach), [None] * (n + self.reach)
        best[start] = 0.0
        for edge in self.edges(text, lead, n):
            s, e, _, score = edge
            if best[s] + score > best[e]:
                best[e], back[e] = best[s] + score, edge
        out: list[tuple[int, ...]] = []
        at = n + end
        while at > start:
            out.append(back[at][2])
            at = back[at][0]
        return list(chain.from_iterable(reversed(out)))


@lru_cache(2)
def pieces(path: str) -> Pieces:
    """The model of a file, once for each Python worker."""
    with open(path, "rb") as f:
        return Pieces(f.read())


def combine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Max-plus product: the transfer matrix of two neighbouring stretches."""
    return (a[:, :, None] + b[None, :, :]).max(axis=1)


def states(matrices: list[np.ndarray], start: int, end: int) -> list[tuple[int, int]]:
    """The states at both ends of each stretch on a best path from ``start`` to ``end``."""
    forward = [np.where(np.arange(len(matrices[0])) == start, 0.0, -np.inf)]
    for m in matrices:
        forward.append((forward[-1][:, None] + m).max(axis=0))
    out = []
    for v, m in zip(reversed(forward[:-1]), reversed(matrices), strict=True):
        before = int(np.argmax(v + m[:, end]))
        out.append((before, end))
        end = before
    return out[::-1]


def _matrix(values: np.ndarray, rows: int) -> np.ndarray:
    return np.asarray(values, float).reshape(rows, -1)


def _matrices(pdf: pd.DataFrame) -> list[np.ndarray]:
    return [_matrix(m, k) for m, k in zip(pdf["matrix"], pdf["rows"], strict=True)]


def _product(pdf: pd.DataFrame) -> pd.DataFrame:
    first, *rest = _matrices(pdf.sort_values("chunk"))
    for m in rest:
        first = combine(first, m)
    return pd.DataFrame({"key": [pdf["key"].iloc[0]], "block": [pdf["block"].iloc[0]], "rows": [len(first)], "matrix": [first.ravel()]})


def _block_states(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values("block")
    found = states(_matrices(pdf), 0, 0)
    return pd.DataFrame({"key": pdf["key"], "block": pdf["block"], "start": [s for s, _ in found], "end": [e for _, e in found]})


def _chunk_states(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values("chunk")
    found = states(_matrices(pdf), int(pdf["start"].iloc[0]), int(pdf["end"].iloc[0]))
    return pd.DataFrame({"key": pdf["key"], "chunk": pdf["chunk"], "s": [s for s, _ in found], "e": [e for _, e in found]})


def scan(giants: DataFrame, path: str = MODEL, chunk: int = CHUNK) -> DataFrame:
    """key, ids, n_chunks for rows key, text."""

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = pieces(path)
        for batch in batches:
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                for k, lead, n, part in p.chunks(p.sp.normalize(text.as_py()), chunk):
                    yield pa.RecordBatch.from_pylist([{"key": key, "chunk": k, "block": k // BLOCK, "lead": lead, "n": n, "part": part}], schema=arrow)

    def transfer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = pieces(path)
        for batch in batches:
            for at in range(batch.num_rows):
                row = batch.slice(at, 1)
                matrix = p.transfer(*(row.column(name)[0].as_py() for name in ("part", "lead", "n")))
                numbers = pa.array([len(matrix)], pa.int64()), pa.array([matrix.ravel().tolist()], pa.list_(pa.float64()))
                yield pa.RecordBatch.from_arrays([*row.columns, *numbers], [*row.schema.names, "rows", "matrix"])

    columns = "key string, chunk long, block long, lead long, n long, part string"
    arrow = pa.schema([("key", pa.string()), ("chunk", pa.int64()), ("block", pa.int64()), ("lead", pa.int64()), ("n", pa.int64()), ("part", pa.string())])
    dealt = giants.select("key", "text").mapInArrow(split, columns).repartition("key", "chunk")  # the chunks of one document are work for many tasks
    parts = cut(dealt.mapInArrow(transfer, f"{columns}, rows long, matrix array<double>"))
    light = parts.select("key", "block", "chunk", "rows", "matrix")
    blocks = light.groupBy("key", "block").applyInPandas(_product, "key string, block long, rows long, matrix array<double>")
    ends = blocks.groupBy("key").applyInPandas(_block_states, "key string, block long, start long, end long")
    at = light.join(ends, ["key", "block"]).groupBy("key", "block").applyInPandas(_chunk_states, "key string, chunk long, s long, e long")

    def trace(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = pieces(path)
        for batch in batches:
            key, k, lead, n, part, s, e = (c.to_pylist() for c in batch.columns)
            ids = [p.trace(*x) for x in zip(part, lead, n, s, e, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(key, pa.string()), pa.array(k, pa.int64()), pa.array(ids, pa.list_(pa.int32()))], ["key", "chunk", "ids"])

    traced = parts.join(at, ["key", "chunk"]).select("key", "chunk", "lead", "n", "part", "s", "e").mapInArrow(trace, "key string, chunk long, ids array<int>")
    ordered = F.array_sort(F.collect_list(F.struct("chunk", "ids")))
    return traced.groupBy("key").agg(F.flatten(F.transform(ordered, lambda x: x["ids"])).alias("ids"), F.count("*").alias("n_chunks"))


def _slices(batches: Iterator[pa.RecordBatch], size: int = 2_000_000) -> Iterator[pa.RecordBatch]:
    """Batches cut so that each holds about ``size`` bytes: lists of ids take many times the room of their text."""
    for batch in batches:
        ends = np.cumsum(pa.compute.fill_null(pa.compute.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < batch.num_rows:
            to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + size, "right")))
            yield batch.slice(at, to - at)
            at = to


def encode(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str = MODEL, giant: int = GIANT, chunk: int = CHUNK, keep: tuple[str, ...] = (), check: bool = False
) -> DataFrame:
    """One row per document row: id, the columns in ``keep``, ids, n_tokens, n_chunks (1 if the library took the whole text).

    ``check`` adds round_trip: whether the ids decode to the text (U+2581 as a blank), decoded where they were encoded.
    """
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"), *[F.col(c).alias(f"_k{i}") for i, c in enumerate(keep)])
    large = F.coalesce(F.length("_text") > giant, F.lit(False))

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sp = pieces(path).sp
        for batch in _slices(batches):
            texts = [t or "" for t in batch.column(1).to_pylist()]
            ids = sp.encode(texts, num_threads=1)
            same = [pa.array([sp.decode(i) == t.replace(SPACE, " ") for i, t in zip(ids, texts, strict=True)])] if check else []
            offsets = np.concatenate([[0], np.cumsum([len(x) for x in ids], dtype=np.int64)]).astype(np.int32)
            values = pa.array(np.fromiter(chain.from_iterable(ids), np.int32, int(offsets[-1])))
            yield pa.RecordBatch.from_arrays([*(c for i, c in enumerate(batch.columns) if i != 1), pa.ListArray.from_arrays(pa.array(offsets), values), *same], names)

    kept = [f"_k{i}" for i in range(len(keep))]
    names = ["_id", *kept, "ids", *(["round_trip"] if check else [])]
    small = rows.filter(~large)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in small.select("_id", *kept).schema)
    done = small.mapInArrow(whole, f"{schema}, ids array<int>" + ", round_trip boolean" * check).withColumn("n_chunks", F.lit(1).cast("long"))
    key = F.sha2("_text", 256)
    giants = rows.filter(large).withColumn("key", key)
    scanned = scan(giants.groupBy("key").agg(F.any_value("_text").alias("text")), path, chunk)
    met = giants.join(scanned, "key")
    met = met.withColumn("round_trip", decode(F.col("ids"), path) == F.translate("_text", SPACE, " ")) if check else met
    both = done.unionByName(met.select(*names, "n_chunks"))
    return both.select(F.col("_id").alias(id_col), *[F.col(k).alias(c) for k, c in zip(kept, keep, strict=True)], "ids", F.size("ids").cast("long").alias("n_tokens"), "n_chunks", *names[len(kept) + 2 :])


def decode(ids: Column, path: str = MODEL) -> Column:
    """The text of an array of ids; null stays null."""

    def text(arrays: pd.Series) -> pd.Series:
        sp = pieces(path).sp
        return pd.Series([None if a is None else sp.decode(np.asarray(a).tolist()) for a in arrays], dtype=object)

    return F.pandas_udf(text, "string")(ids)
