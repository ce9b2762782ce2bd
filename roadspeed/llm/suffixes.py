"""Removal of repeated substrings by suffix arrays.

Every byte covered by a ``LENGTH``-byte string that also starts anywhere else goes. Suffix arrays of whole shards would sort
every byte of the corpus, so the work is first cut down to what can match, without loss:

1. Anchors. The 64-byte string with the smallest hash in a window of ``LENGTH`` bytes is its anchor. Equal windows have equal
   anchors at equal offsets. Consecutive windows with one anchor form a unit. Spark counts units by anchor, in one exchange:
   windows of an anchor that occurs once are unique; units that are equal as a whole are repeated as a whole. A task sends two
   rows of equal units to their anchor, and further ones, which are repeated for certain, by a hash of their own.
2. Shards. What is left are anchors with several different units. One copy of each different unit is sent by anchor to a
   shard. Equal windows lie at equal offsets from their anchor, so a range of ``RANGE`` offsets is sorted only if the bytes
   that all its windows share occur twice there. A suffix array is built by Larsson-Sadakane refinement in numpy (eight bytes
   at first, then doubling; only groups not yet apart are sorted again), and Kasai's method gives the common prefixes of
   neighbours. Windows whose common prefix with a neighbour is LENGTH or more are repeated.
3. Hot anchors. An anchor with more than ``HOT`` different units is no shard of its own: equal windows lie at equal offsets
   from the anchor, so its units are split into aligned ranges of offsets, halved from round to round, and counted by the
   bytes that all windows of a range share, as in step 1. This takes the place of merging shards pairwise by binary search,
   whose cost grows with the square of the shards of one hot string.

Texts are read from the table again where their bytes are asked for; only those that a bitmap of keys lets through are shuffled.

Defined cases: a null text is empty; texts shorter than LENGTH keep all bytes; copies of a text, and repeated rows, are
each removed as a whole if they have LENGTH bytes; matches never cross documents. Other columns are left out.
"""

from __future__ import annotations

import hashlib
import uuid
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, shared_dir

LENGTH = 400
GRAM = 64
HOT = 4096
#: Offsets from the anchor of one range of windows inside a shard.
RANGE = 64
SHARD_BYTES = 1_000_000
#: Different units that a task remembers before it begins anew.
KINDS = 200_000
#: Bits of the map of keys at most (16 MB, broadcast). A fuller map lets more texts through, and loses none.
MAP_BITS = 1 << 27
#: States of a unit's row: counted at its anchor; the same, of an anchor that has many in this task; one of those many that
#: is not counted; repeated for certain, from two equal rows that this task sent before.
_COUNTED, _CROWDED, _PASSED, _KNOWN = range(4)
#: Bytes hashed at once; a longer document is hashed in pieces that overlap.
_PIECE = 1_000_000
_PLACE = np.uint64((1 << 24) - 1)
_BASE = 0x9E3779B97F4A7C15 | 1


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    with np.errstate(over="ignore"):
        up, down = np.full(n, _BASE, np.uint64), np.full(n, pow(_BASE, -1, 1 << 64), np.uint64)
        up[0] = down[0] = 1
        return np.cumprod(up), np.cumprod(down)


_POWERS = [_powers(1024)]


def gram_hashes(data: np.ndarray, size: int = GRAM) -> np.ndarray:
    """A 64-bit hash of every ``size`` consecutive bytes."""
    n = len(data)
    if len(_POWERS[0][0]) < n:
        _POWERS[0] = _powers(max(n, 2 * _PIECE))
    up, down = _POWERS[0]
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[:n], out=sums[1:])
    h = (sums[size:] - sums[:-size]) * down[: n - size + 1]
    h ^= h >> np.uint64(31)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(29)
    return h


def window_minima(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` consecutive values, by block-wise running minima from both sides."""
    n = len(values)
    blocks = -(-n // width)
    padded = np.full(blocks * width, np.iinfo(values.dtype).max, values.dtype)
    padded[:n] = values
    grid = padded.reshape(blocks, width)
    ahead = np.minimum.accumulate(grid, axis=1).ravel()
    back = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[: n - width + 1], ahead[width - 1 : n])


def units(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, ...]:
    """Owner, first window, number of windows, anchor place (all within the data) and anchor hash of each unit of texts that lie end to end."""
    gram = min(GRAM, length)
    if len(data) < length:
        return tuple(np.zeros(0, np.int64) for _ in range(4)) + (np.zeros(0, np.uint64),)
    h = gram_hashes(data, gram)
    place = np.arange(len(h), dtype=np.uint64)
    anchor = (window_minima((h & ~_PLACE) | place, length - gram + 1) & _PLACE).astype(np.int64)
    last = starts + sizes - length  # the last window of each text
    owner = np.repeat(np.arange(len(starts)), np.maximum(last - starts + 1, 0))
    if not len(owner):
        return tuple(np.zeros(0, np.int64) for _ in range(4)) + (np.zeros(0, np.uint64),)
    first = np.concatenate([[0], np.cumsum(np.maximum(last - starts + 1, 0))[:-1]])
    window = np.arange(len(owner)) - first[owner] + starts[owner]
    at = anchor[window]
    new = np.flatnonzero(np.concatenate([[True], (at[1:] != at[:-1]) | (owner[1:] != owner[:-1])]))
    count = np.diff(np.concatenate([new, [len(owner)]]))
    return owner[new], window[new], count, at[new], h[at[new]]


def _pieces(texts: Iterator[tuple[bytes, bytes]], length: int) -> Iterator[list[tuple[bytes, int, bytes]]]:
    """Lists of (key, offset, bytes) of about _PIECE bytes; long texts in pieces that overlap by length - 1 bytes."""
    held, size = [], 0
    for key, data in texts:
        if len(data) < length:
            continue
        for at in range(0, len(data) - length + 1, _PIECE):
            part = data[at : at + _PIECE + length - 1]
            held.append((key, at, part))
            size += len(part)
            if size >= _PIECE:
                yield held
                held, size = [], 0
    if held:
        yield held


def _unit_rows(length: int, crowd: int):
    """Rows of units. ``deal`` is the anchor, but of rows that need not be counted there: so no anchor gets more rows of a task than two of each of ``crowd`` units."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, kinds, copies = {}, {}, {}

        def texts(batch: pa.RecordBatch) -> Iterator[tuple[bytes, bytes]]:
            for k, t in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                copies[k] = copies.get(k, 0) + 1
                if copies[k] < 3:  # units are told by key: two copies show that all of them are repeated
                    yield k, (t.as_py() or "").encode()

        def state(anchor: int, whole: bytes) -> int:
            times = seen.get(whole, 0)
            if times > 1:
                return _KNOWN
            seen[whole] = times + 1
            if not times:
                kinds[anchor] = kinds.get(anchor, 0) + 1
            return _COUNTED if kinds[anchor] <= crowd else _CROWDED if kinds[anchor] == crowd + 1 else _PASSED

        for batch in batches:
            for part in _pieces(texts(batch), length):
                joined = b"".join(x for _, _, x in part)
                sizes = np.array([len(x) for _, _, x in part])
                starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
                owner, first, count, at, h = units(np.frombuffer(joined, np.uint8), starts, sizes, length)
                ends = (first + count + length - 1).tolist()
                whole = [xxhash.xxh3_128_digest(joined[s:e]) for s, e in zip(first.tolist(), ends, strict=True)]
                shift = np.array([o for _, o, _ in part])[owner] - starts[owner]
                anchor = h.view(np.int64)
                states = [state(a, w) for a, w in zip(anchor.tolist(), whole, strict=True)]
                deal = anchor.copy()
                for i in np.flatnonzero(np.array(states) >= _PASSED).tolist():
                    deal[i] = xxhash.xxh3_64_intdigest(part[owner[i]][0], seed=int(first[i] + shift[i])) - (1 << 63)
                keys = pa.array([k for k, _, _ in part], pa.binary()).take(pa.array(owner))
                columns = [pa.array(deal), pa.array(anchor), pa.array(whole, pa.binary()), keys, pa.array(first + shift), pa.array(count), pa.array(at + shift), pa.array(states, pa.int32())]
                yield pa.RecordBatch.from_arrays(columns, ["deal", "anchor", "whole", "key", "first", "n", "place", "state"])
                if len(seen) > KINDS:
                    seen.clear()
                    kinds.clear()
                if len(copies) > KINDS:
                    copies.clear()

    return run


_UNIT = "deal long, anchor long, whole binary, key binary, first long, n long, place long, state int"


def marked_units(rows: DataFrame, hot: int) -> DataFrame:
    """Units that are repeated as a whole (``again``), and those of anchors that have several different ones (``left``: one copy of each; ``many``: it is repeated, ``others``: units of the anchor)."""
    apart = F.col("state") >= _PASSED
    group, kind = Window.partitionBy("deal", apart), Window.partitionBy("deal", apart, "whole")
    met = rows.withColumn("_near", F.count("*").over(group)).filter(apart | (F.col("_near") > 1))
    met = met.withColumn("_fresh", F.row_number().over(kind.orderBy("key", "first")) == 1).withColumn("_c", F.count("*").over(kind))
    met = met.withColumns({"_kinds": F.sum(F.col("_fresh").cast("int")).over(group), "_crowded": F.max(F.col("state") == _CROWDED).over(group)})
    crowded = (F.col("state") == _PASSED) | (~apart & F.col("_crowded"))
    many = ~apart & (F.col("_c") > 1)
    again = (F.col("state") == _KNOWN) | many
    left = (F.col("state") == _PASSED) | (~apart & F.col("_fresh") & (F.col("_crowded") | (F.col("_kinds") > 1)))
    others = F.when(crowded, F.greatest("_kinds", F.lit(hot + 1))).otherwise(F.col("_kinds"))
    out = met.select("anchor", "key", "first", "n", "place", again.alias("again"), left.alias("left"), many.alias("many"), others.cast("long").alias("others"))
    return out.filter(F.col("again") | F.col("left"))


def _stored(df: DataFrame) -> DataFrame:
    """As Parquet in the shared folder: a fraction of a checkpoint's bytes."""
    df.write.parquet(path := f"{shared_dir(df.sparkSession)}/suffixes-{uuid.uuid4().hex}")
    return df.sparkSession.read.schema(df.schema).parquet(path)


def by_keys(docs: DataFrame, keys: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows whose key may be among ``keys``, and rows whose key is not, by a bitmap of hashed keys that is broadcast."""
    n = keys.agg(F.approx_count_distinct("key")).first()[0]
    bits = min(MAP_BITS, 1 << max(15, (32 * n).bit_length()))
    place = F.pmod(F.xxhash64("key"), F.lit(bits)) + 1  # the bitmap functions count from 1
    cells = keys.select(place.alias("_p")).select(F.bitmap_bucket_number("_p").alias("_of"), F.bitmap_bit_position("_p").alias("_at"))
    cells = cells.repartition("_of").groupBy("_of").agg(F.bitmap_construct_agg("_at").alias("_map"))
    at = F.bitmap_bit_position("_p")
    byte = F.conv(F.hex(F.substring(F.col("_map"), (F.floor(at / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("long")
    met = docs.withColumn("_p", place).join(F.broadcast(cells), F.bitmap_bucket_number("_p") == F.col("_of"), "left")
    met = met.withColumn("_in", F.coalesce(F.getbit(byte, (at % 8).cast("int")) == 1, F.lit(False)))
    return met.filter("_in").select(docs.columns), met.filter("NOT _in").select(docs.columns)


def split_repeats(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Units that are repeated as a whole (key, first, n), and one copy of each different unit of anchors that have several (with ``many``: it is repeated, ``others``: units of the anchor)."""
    carried = [c for c in rows.columns if c not in ("anchor", "whole")]
    kinds = cut(rows.groupBy("anchor", "whole").agg(F.count("*").alias("_c"), F.min_by(F.struct(*carried), F.struct("key", "first")).alias("_u")))
    twice = kinds.filter("_c > 1").select(F.col("anchor").alias("_a"), F.col("whole").alias("_w"))
    repeated = rows.join(twice, (F.col("anchor") == F.col("_a")) & (F.col("whole") == F.col("_w")), "left_semi").select("key", "first", "n")
    several = kinds.groupBy("anchor").agg(F.count("*").alias("others")).filter("others > 1")
    left = kinds.join(several, "anchor").select("anchor", "_u.*", (F.col("_c") > 1).alias("_twice"), "others")
    many = (F.col("_twice") | F.col("many")) if "many" in carried else F.col("_twice")
    return repeated, left.withColumn("many", many).drop("_twice")


def suffix_array(data: np.ndarray, depth: int) -> np.ndarray:
    """Suffixes in order of their first ``depth`` bytes at least, then of place, by Larsson-Sadakane refinement."""
    n = len(data)
    padded = np.concatenate([data, np.zeros(8, np.uint8)]).astype(np.uint64)
    first = np.zeros(n, np.uint64)
    for t in range(8):
        first = (first << np.uint64(8)) | padded[t : t + n]
    order = np.argsort(first)
    ranked = first[order]
    rank = np.zeros(n + 1, np.int64)  # the slot at which the group of a suffix begins, counted from 1; 0 past the end

    def groups(slots: np.ndarray, fresh: np.ndarray) -> np.ndarray:
        """Slots whose group holds more than one suffix, after ranks were set from the group starts ``fresh``."""
        head = np.maximum.accumulate(np.where(fresh, slots, 0))
        rank[order[slots]] = head + 1
        alone = fresh & np.concatenate([fresh[1:], [True]])
        return slots[~alone]

    slots = np.arange(n)
    active = groups(slots, np.concatenate([[True], ranked[1:] != ranked[:-1]])) if n else slots
    step = 8
    while step < depth and len(active):
        at = order[active]
        keys = (rank[at] << 32) | rank[np.minimum(at + step, n)]
        by = np.argsort(keys)
        order[active] = at[by]
        keys = keys[by]
        active = groups(active, np.concatenate([[True], keys[1:] != keys[:-1]]))
        step *= 2
    at = order[active]
    order[active] = at[np.argsort((rank[at] << 32) | at)]
    return order


def common_prefixes(data: np.ndarray, order: np.ndarray, starts: np.ndarray, counts: np.ndarray, cap: int) -> tuple[np.ndarray, np.ndarray]:
    """Kasai's method for the suffixes in ``order``, which are the first ``counts`` ones behind each of ``starts``.

    Returns for every position the suffix before it in order (-1: none) and their common prefix up to ``cap``. All strings
    advance in step: the prefix of a position is at least that of the position before it less one, unless the order is turned.
    Suffixes that are tied at the depth of the order are in order of place, and those one byte later need not be tied.
    """
    before = np.full(len(data) + 1, -1)
    before[order[1:]] = order[:-1]
    slot = np.full(len(data) + 2, len(order))  # past all others, if not in order
    slot[order] = np.arange(len(order))
    prefix = np.zeros(len(data) + 1, np.int64)
    by = np.argsort(-counts)
    starts, counts = starts[by], counts[by]
    held = np.zeros(len(starts), np.int64)
    for i in range(int(counts[0]) if len(counts) else 0):
        live = int(np.searchsorted(-counts, -i, "left"))  # strings with more than i suffixes
        p = starts[:live] + i
        q = before[p]
        known = np.maximum(held[:live] - 1, 0)
        if i:
            earlier = before[p - 1]
            known[(earlier < 0) | (slot[earlier + 1] > slot[p])] = 0
        known[q < 0] = 0
        going = np.flatnonzero((q >= 0) & (known < cap))
        while len(going):
            a, b = data[p[going] + known[going]], data[q[going] + known[going]]
            going = going[(a == b) & (a != 0)]
            known[going] += 1
            going = going[known[going] < cap]
        held[:live] = known
        prefix[p] = known
    return before, prefix


def repeated_windows(strings: list[bytes], counts: np.ndarray, length: int = LENGTH) -> np.ndarray:
    """For the windows of all strings, one after another, whether the same ``length`` bytes start another window."""
    joined = np.frombuffer(b"\x00".join(s.translate(_NO_ZERO) for s in strings) + b"\x00" * (length + 8), np.uint8)
    sizes = np.array([len(s) for s in strings])
    starts = np.concatenate([[0], np.cumsum(sizes + 1)[:-1]])
    window = np.repeat(starts, counts) + np.arange(int(counts.sum())) - np.repeat(np.cumsum(counts) - counts, counts)
    member = np.zeros(len(joined), bool)
    member[window] = True
    # Sorted past the end of the longest string: only suffixes equal to their ends are tied.
    order = suffix_array(joined[: int(starts[-1] + sizes[-1] + 1)], int(sizes.max()) + 1)
    order = order[member[order]]
    before, prefix = common_prefixes(joined, order, starts, counts, length)
    again = np.zeros(len(joined) + 1, bool)
    far = window[prefix[window] >= length]
    again[far] = True
    again[before[far]] = True
    return again[window]


# The byte 0 parts strings; UTF-8 never holds 0xFF, which stands for it.
_NO_ZERO = bytes([255, *range(1, 256)])


def _runs(flags: np.ndarray) -> list[tuple[int, int]]:
    """Start and end (exclusive) of each run of true values."""
    edge = np.flatnonzero(np.diff(np.concatenate([[0], flags.astype(np.int8), [0]])))
    return list(zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True))


_LEFT = "anchor long, key binary, first long, n long, place long, many boolean, part binary"


def likely_runs(units: list[tuple], length: int, size: int = RANGE) -> list[tuple]:
    """The runs of windows of an anchor's units whose shared bytes occur twice: key, first, n, many, bytes.

    units: key, first, n, place, many, bytes. Ranges of offsets are aligned at the anchor, neighbouring ones are joined again.
    """
    size = min(size, length)
    ranges, times = [], Counter()
    for key, first, n, place, many, part in units:
        own = []
        for j in range((place - first) // size, (place - first - n + 1) // size - 1, -1):
            head = place - j * size
            mark = (j, part[head - first : head - size + 1 + length - first])
            times[mark] += 1
            own.append((mark, max(first, head - size + 1), min(first + n - 1, head)))
        ranges.append((key, first, many, part, own))
    out = []
    for key, first, many, part, own in ranges:
        runs: list[list[int]] = []
        for mark, lo, hi in own:
            if times[mark] > 1:
                if runs and runs[-1][1] + 1 == lo:
                    runs[-1][1] = hi
                else:
                    runs.append([lo, hi])
        out += [(key, lo, hi - lo + 1, many, part[lo - first : hi + length - first]) for lo, hi in runs]
    return out


def _shards(length: int, shard_bytes: int):
    """Repeated runs of windows of units that come sorted by anchor; a shard holds whole anchors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group: dict[tuple, tuple] = {}  # keyed, since a row of the table may be repeated
        shard: list[tuple] = []

        def out() -> pa.RecordBatch:
            rows = list(shard)
            keys, firsts, counts = [], [], []
            if rows:
                n = np.array([r[2] for r in rows])
                flags = repeated_windows([r[4] for r in rows], n, length)
                at = 0
                for key, first, k, many, _ in rows:
                    if not many:
                        for a, b in _runs(flags[at : at + k]):
                            keys.append(key)
                            firsts.append(first + a)
                            counts.append(b - a)
                    at += k
            shard.clear()
            return pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(firsts, pa.int64()), pa.array(counts, pa.int64())], ["key", "first", "n"])

        last, held = None, 0
        for batch in batches:
            for anchor, *row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if anchor != last:
                    more = likely_runs(list(group.values()), length)
                    size = sum(len(r[-1]) for r in more)
                    if shard and held + size > shard_bytes:
                        yield out()
                        held = 0
                    shard += more
                    held += size
                    group = {}
                    last = anchor
                group[row[0], row[1]] = tuple(row)
        shard += likely_runs(list(group.values()), length)
        yield out()

    return run


def _halve(size: int, length: int):
    """Units in ranges of ``size`` offsets from their anchor, keyed by the bytes that all windows of the range share."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for anchor, key, first, n, place, many, part in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                for j in range((place - first - n + 1) // size, (place - first) // size + 1):
                    lo, hi = max(first, place - (j + 1) * size + 1), min(first + n - 1, place - j * size)
                    shared = part[place - j * size - first : place - (j + 1) * size + 1 + length - first]
                    whole = part[lo - first : hi + length - first]
                    mark = xxhash.xxh3_64_intdigest(shared, seed=(anchor * 1_000_003 + j * 31 + size) & (2**64 - 1)) - (1 << 63)
                    rows.append((mark, xxhash.xxh3_128_digest(whole + (lo - place).to_bytes(8, "big", signed=True)), key, lo, hi - lo + 1, place, many, whole))
            columns = list(zip(*rows, strict=True)) if rows else [[]] * 8
            types = [pa.int64(), pa.binary(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["anchor", "whole", "key", "first", "n", "place", "many", "part"])

    return run


def _cut_parts(length: int):
    """The bytes of the units that a text is asked for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in _LEFT.split(", ")] + ["others"]
        for batch in batches:
            for key, text, asked in zip(*batch.columns, strict=True):
                data = (text.as_py() or "").encode()
                rows = [{**u, "key": key.as_py(), "part": data[u["first"] : u["first"] + u["n"] + length - 1]} for u in asked.as_py()]
                yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], t) for c, t in zip(names, _LEFT_TYPES, strict=True)], names)

    return run


_LEFT_TYPES = [pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.binary(), pa.int64()]


def _asked_parts(docs: DataFrame, left: DataFrame, length: int) -> DataFrame:
    """The units with their bytes. Only texts that are asked for are shuffled, one row by key."""
    few, _ = by_keys(docs, left)
    one = few.groupBy("key").agg(F.min("id").alias("_id")).withColumnRenamed("key", "_key")
    asked = left.groupBy("key").agg(F.collect_list(F.struct("anchor", "first", "n", "place", "many", "others")).alias("asked"))
    asked = asked.join(one, F.col("key") == F.col("_key")).select("_key", "_id", "asked")
    texts = few.join(asked, (F.col("key") == F.col("_key")) & F.col("id").eqNullSafe(F.col("_id")))
    return texts.select("key", "text", "asked").mapInArrow(_cut_parts(length), f"{_LEFT}, others long")


def repeated_runs(docs: DataFrame, length: int = LENGTH, hot: int = HOT, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """key, first, n: runs of repeated windows of rows id, key, text (key: a digest of the text)."""
    rows = docs.select("key", "text").mapInArrow(_unit_rows(length, max(1, hot // 4)), _UNIT)
    marked = _stored(marked_units(rows, hot))
    left = marked.filter("left").drop("again", "left")
    found = [marked.filter("again").select("key", "first", "n")]

    def sharded(parts: DataFrame) -> DataFrame:
        rows = parts.select("anchor", "key", "first", "n", "place", "many", "part").repartition("anchor").sortWithinPartitions("anchor")
        return rows.mapInArrow(_shards(length, shard_bytes), "key binary, first long, n long")

    cold, large = left.filter(F.col("others") <= hot), left.filter(F.col("others") > hot)
    found.append(sharded(_asked_parts(docs, cold, length)))
    size = 1 << (length - GRAM if length > GRAM else 1).bit_length()
    if not large.isEmpty():
        large = cut(_asked_parts(docs, large, length))
        while size > 1:
            size //= 2
            fields = _LEFT.replace("anchor long", "anchor long, whole binary")
            split = cut(large.select("anchor", "key", "first", "n", "place", "many", "part").mapInArrow(_halve(size, length), fields))
            again, parts = split_repeats(split)
            parts = cut(parts)
            found += [again, sharded(parts.filter(F.col("others") <= hot))]
            large = parts.filter(F.col("others") > hot)
            if large.isEmpty():
                break
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return out


def _keep(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text, runs in zip(batch.column(1), batch.column(2).to_pylist(), strict=True):
                data = (text.as_py() or "").encode()
                spans: list[tuple[int, int]] = []
                for first, n in sorted((r["first"], r["n"]) for r in runs or []):
                    e = first + n + length - 1
                    if spans and first <= spans[-1][1]:
                        spans[-1] = (spans[-1][0], max(e, spans[-1][1]))
                    else:
                        spans.append((first, e))
                ends = [0, *(e for _, e in spans)]
                kept = b"".join(data[a:b] for a, b in zip(ends, [*(s for s, _ in spans), len(data)], strict=True))
                out.append((len(data), len(data) - len(kept), len(spans), hashlib.sha256(kept).hexdigest(), [{"start": s, "end": e} for s, e in spans]))
            columns = list(zip(*out, strict=True)) if out else [[]] * 5
            types = [pa.int64()] * 3 + [pa.string(), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(columns, types, strict=True))], ["id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans"])

    return run


def remove_repeats(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, hot: int = HOT, shard_bytes: int = SHARD_BYTES
) -> DataFrame:
    """One row per document row: id, n_bytes, n_removed, n_spans, kept_sha256, spans (of removed bytes, end exclusive)."""
    key = F.unhex(F.substring(F.sha2(F.coalesce(F.col(text_col), F.lit("")), 256), 1, 32))
    rows = docs.select(F.col(id_col).alias("id"), key.alias("key"), F.col(text_col).alias("text"))
    runs = repeated_runs(rows, length, hot, shard_bytes)
    by_key = _stored(runs.groupBy("key").agg(F.collect_set(F.struct("first", "n")).alias("runs")))
    some, none = by_keys(rows, by_key)  # texts without repeats stay where they are
    met = some.join(by_key.withColumnRenamed("key", "_key"), F.col("key") == F.col("_key"), "left").select("id", "text", "runs")
    met = met.unionByName(none.select("id", "text", F.lit(None).cast(by_key.schema["runs"].dataType).alias("runs")))
    kind = rows.schema["id"].dataType.simpleString()
    schema = f"id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<struct<start: long, end: long>>"
    return met.mapInArrow(_keep(length), schema).withColumnRenamed("id", id_col)
