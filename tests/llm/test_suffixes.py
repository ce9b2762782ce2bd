"""Repeated substrings against brute force; the suffix array and the common prefixes against sorted suffixes."""

import hashlib
import os
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from roadspeed.llm import suffixes
from roadspeed.operators.base import shared_dir


def brute(texts, length):
    data = [(t or "").encode() for t in texts]
    seen = Counter(d[i : i + length] for d in data for i in range(len(d) - length + 1))
    out = []
    for d in data:
        hit = np.zeros(len(d) + 1, bool)
        for i in range(len(d) - length + 1):
            if seen[d[i : i + length]] > 1:
                hit[i : i + length] = True
        kept = bytes(b for b, h in zip(d, hit, strict=False) if not h)
        out.append((len(d), int(hit.sum()), int((np.diff(hit.astype(int)) == 1).sum() + hit[0]), hashlib.sha256(kept).hexdigest()))
    return out


def made(seed, alphabet="abcdé \x00"):
    r = random.Random(seed)
    some = lambda n: "".join(r.choice(alphabet) for _ in range(n))
    shared = [some(r.randint(20, 160)) for _ in range(5)]
    texts = [None, "", "short", "ab" * 150, "x" * 300, some(900)]
    for _ in range(30):
        texts.append("".join(r.choice([some(r.randint(0, 60)), r.choice(shared), r.choice(shared)[r.randint(0, 9) :]]) for _ in range(r.randint(0, 6))))
    near = list(some(700))
    for _ in range(12):
        edit = list(near)
        for _ in range(4):
            edit[r.randrange(len(edit))] = "#"
        texts.append("".join(edit))
    return texts + texts[6:9]


@pytest.mark.parametrize(("length", "hot", "shard"), [(40, 4096, 1_000_000), (40, 2, 1_000_000), (40, 4096, 500), (9, 3, 200), (100, 1, 10_000)])
def test_remove_repeats(spark, length, hot, shard):
    texts = made(length + hot)
    rows = [(i, t, "x", 0) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, key string, n long")
    found = {r.doc_id: r for r in suffixes.remove_repeats(df, length=length, hot=hot, shard_bytes=shard).collect()}
    for i, expected in enumerate(brute(texts, length)):
        r = found[i]
        assert (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) == expected, i


def test_contract_length(spark):
    r = random.Random(9)
    some = lambda n: "".join(r.choice("abcdefgh ") for _ in range(n))
    passage, base = some(600), some(3000)
    texts = [some(500) + passage + some(300), passage[:400], passage[1:400], some(200) + passage, base, base[:1500] + "#" + base[1500:], "word " * 500, some(399)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(99, texts[7] + "x"), (99, texts[7] + "x")], "doc_id long, text string")
    found = sorted(suffixes.remove_repeats(df).collect(), key=lambda x: x.doc_id)
    assert [tuple(x)[1:5] for x in found] == brute([*texts, texts[7] + "x", texts[7] + "x"], 400)


def test_empty(spark):
    assert suffixes.remove_repeats(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_long_text_in_pieces(monkeypatch):
    r = random.Random(3)
    data = bytes(r.choice(b"abc") for _ in range(5_000))
    whole = [(b"k", data)]
    monkeypatch.setattr(suffixes, "_PIECE", 700)
    covered = []
    for part in suffixes._pieces(iter(whole), 50):
        for _, at, x in part:
            _, first, count, _, _ = suffixes.units(np.frombuffer(x, np.uint8), np.array([0]), np.array([len(x)]), 50)
            covered += [w + at for f, c in zip(first, count, strict=True) for w in range(f, f + c)]
    assert covered == list(range(len(data) - 49))


def test_suffix_array_and_prefixes():
    r = np.random.default_rng(1)
    data = r.integers(1, 3, 400).astype(np.uint8)
    data[[100, 250, 399]] = 0
    order = suffixes.suffix_array(data, 512)
    assert order.tolist() == sorted(range(400), key=lambda i: data[i:].tobytes())
    starts, counts = np.array([0, 101, 251]), np.array([60, 149, 100])
    member = np.concatenate([np.arange(s, s + c) for s, c in zip(starts, counts, strict=True)])
    order = order[np.isin(order, member)]
    padded = np.concatenate([data, np.zeros(60, np.uint8)])
    before, prefix = suffixes.common_prefixes(padded, order, starts, counts, 50)
    for a, b in zip(order[:-1].tolist(), order[1:].tolist(), strict=True):
        k = 0
        while k < 50 and padded[a + k] == padded[b + k] != 0:
            k += 1
        assert before[b] == a
        assert prefix[b] == k


def test_planted_passages(spark):
    """Passages of 400 bytes or more go wherever they repeat; shorter ones, and documents with text of their own, stay whole."""
    r = random.Random(21)
    word = lambda: "".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(r.randint(3, 8)))
    text = lambda n: " ".join(word() for _ in range(n))
    long, short = [text(r.randint(70, 200)) for _ in range(30)], [text(52) for _ in range(10)]
    assert min(map(len, long)) >= 400 > max(map(len, short))
    docs = [(("long", k), f"{text(90)} {p} {text(60)}") for k, p in enumerate(long) for _ in range(r.randint(2, 5))]
    docs += [(("short", k), f"{text(90)} {p} {text(60)}") for k, p in enumerate(short) for _ in range(3)]
    docs += [(("own", k), text(200)) for k in range(100)]
    found = {x.doc_id: x for x in suffixes.remove_repeats(spark.createDataFrame([(i, t) for i, (_, t) in enumerate(docs)], "doc_id long, text string")).collect()}
    for i, ((kind, k), t) in enumerate(docs):
        gone = t.encode()[found[i].spans[0].start : found[i].spans[0].end].decode() if found[i].spans else ""
        assert (long[k] in gone if kind == "long" else not gone), (kind, k)


def test_ranges_that_are_sorted():
    """Of units with one anchor, only ranges of windows whose shared bytes occur twice are kept; what repeats is among them."""
    r = random.Random(4)
    some = lambda n: bytes(r.choice(b"abcd") for _ in range(n))
    core, rows = some(500), []
    for k in range(6):
        body = some(300) + core[: r.randint(100, 500)] + some(300) if k % 2 else some(300) + core + some(300)
        rows.append((bytes([k]), 0, len(body) - 399, 320, False, body))
    kept = {(key, first + i) for key, first, n, _, _ in suffixes.likely_runs(rows, 400) for i in range(n)}
    windows = Counter(row[5][i : i + 400] for row in rows for i in range(row[2]))
    again = {(row[0], i) for row in rows for i in range(row[2]) if windows[row[5][i : i + 400]] > 1}
    assert again and again <= kept
    assert len(kept) < sum(row[2] for row in rows)
    for key, first, n, _, part in suffixes.likely_runs(rows, 400):
        assert part == rows[key[0]][5][first : first + n + 399]


def disk(spark):
    """Bytes of shuffles and of the shared folder, which is where the operator keeps what it has worked out."""
    env = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get()
    tops = [*env.blockManager().diskBlockManager().localDirsString(), shared_dir(spark).removeprefix("file:")]
    return sum(os.path.getsize(os.path.join(d, f)) for top in tops for d, _, names in os.walk(top) for f in names)


def test_disk(spark):
    """Texts without repeats are not shuffled, and units are kept in fewer bytes than the texts."""
    r = random.Random(13)
    texts = ["".join(r.choices("abcdefghijklmnopqrstuvwxyz ", k=8_000)) for _ in range(400)]
    df = spark.createDataFrame([(i, t + (texts[0][:500] if i < 9 else "")) for i, t in enumerate(texts)], "doc_id long, text string")
    before = disk(spark)
    assert suffixes.remove_repeats(df).filter("n_removed > 0").count() == 9
    assert disk(spark) - before < sum(map(len, texts))


def test_rows_sent_to_one_anchor():
    """A task sends two rows of equal units to their anchor at most, and a bounded number of different units of one anchor; none is lost."""
    r = random.Random(14)
    some = lambda n: "".join(r.choices("abcdefgh ", k=n))
    line, passage = some(200), some(900)
    texts = [some(500) + line + some(500) for _ in range(60)] + [some(300) + passage + some(300) for _ in range(40)] + [some(1_500)] * 30
    keys = [hashlib.sha256(t.encode()).digest()[:16] for t in texts]
    batch = pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(texts)], ["key", "text"])
    rows = [x for b in suffixes._unit_rows(400, 10)(iter([batch])) for x in b.to_pylist()]
    counted = [x for x in rows if x["state"] < 2]
    assert max(Counter(x["whole"] for x in counted).values()) == 2
    assert max(Counter(x["deal"] for x in counted).values()) <= 22
    assert all(x["deal"] == x["anchor"] for x in counted)
    assert max(Counter(x["deal"] for x in rows if x["state"] > 1).values()) == 1
    windows = {(k, i) for k, t in zip(keys, texts, strict=True) for i in range(len(t) - 399)}
    assert {(x["key"], x["first"] + i) for x in rows for i in range(x["n"])} == windows
    twice = Counter(t[i : i + 400] for t in texts for i in range(len(t) - 399))
    of = dict(zip(keys, texts, strict=True))
    for x in rows:
        if x["state"] == 3:
            assert all(twice[of[x["key"]][i : i + 400]] > 1 for i in range(x["first"], x["first"] + x["n"]))


def test_rows_by_keys(spark):
    docs = spark.range(5_000).selectExpr("id", "unhex(md5(cast(id % 4000 as string))) AS key")
    some, none = suffixes.by_keys(docs, docs.filter("id % 50 = 7").select("key"))
    found, rest = {x.id for x in some.collect()}, {x.id for x in none.collect()}
    asked = {i for i in range(5_000) if i % 4_000 % 50 == 7}
    assert asked <= found and len(found) < 400
    assert not found & rest and found | rest == set(range(5_000))
    some, none = suffixes.by_keys(docs, docs.filter("id < 0").select("key"))
    assert some.isEmpty() and none.count() == 5_000


@pytest.mark.parametrize("seed", range(20))
def test_equal_ends(seed):
    """Strings with equal ends, of which those that follow begin alike: suffixes are tied beyond the ends, but not one byte later."""
    r = random.Random(seed)
    some = lambda n: bytes(r.choices(b"abcdefgh", k=n))
    end, head = some(70), some(19) + b"h"
    second = head + end  # tied with the first at the depth of 128, as both follow 70 equal bytes: 70 + 1 + 57
    third = second[:57] + bytes([second[57] - 1]) + some(30)
    strings = [some(9) + b"a" + end, second, third, some(100), some(100), some(100)]
    counts = np.array([len(s) - 49 for s in strings])
    windows = [s[i : i + 50] for s, n in zip(strings, counts, strict=True) for i in range(n)]
    times = Counter(windows)
    assert suffixes.repeated_windows(strings, counts, 50).tolist() == [times[w] > 1 for w in windows]
    joined = np.frombuffer(b"\x00".join(strings) + bytes(60), np.uint8)
    starts = np.cumsum([0, *(len(s) + 1 for s in strings[:-1])])
    place = np.concatenate([s + np.arange(n) for s, n in zip(starts, counts, strict=True)])
    order = suffixes.suffix_array(joined[:-59], max(map(len, strings)) + 1)
    before, prefix = suffixes.common_prefixes(joined, order[np.isin(order, place)], starts, counts, 50)
    for p in place[before[place] >= 0].tolist():
        same = (joined[p : p + 50] == joined[before[p] : before[p] + 50]) & (joined[p : p + 50] != 0)
        assert prefix[p] == (50 if same.all() else int(same.argmin())), p
