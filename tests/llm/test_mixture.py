"""Mixing sources: targets and copies against plain loops, and odd rows."""

import hashlib
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from roadspeed.llm import mixture, queries

SF = "/root/testdata/sf0.001"


def brute_targets(sizes, weights=(5, 2, 1), cap=3):
    """sizes: source -> words. Share by weight, stop at the cap, share the excess again until none is above."""
    order = sorted((s for s in sizes if s is not None)) + [s for s in sizes if s is None]
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    capped, whole = set(), sum(sizes.values())
    while True:
        rest, active = whole - sum(cap * sizes[s] for s in capped), sum(weight[s] for s in order if s not in capped)
        more = {s for s in order if s not in capped and cap * sizes[s] * active < weight[s] * rest}
        if not more:
            return {s: float(cap * sizes[s]) if s in capped else weight[s] * rest / active for s in order}
        capped |= more


def brute_taken(i, text, rate, seed=7):
    key = hashlib.md5(f"{seed}:{'' if i is None else i}:{text or ''}".encode()).hexdigest()
    return int(rate) + (int(key[:13], 16) / 2**52 < rate - int(rate))


def brute(docs):
    count = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    sizes = Counter()
    for _, t, s in docs:
        sizes[s] += count(t)
    target = brute_targets(sizes)
    rate = {s: target[s] / n if n else 0.0 for s, n in sizes.items()}
    return sorted((str(i), count(t), sizes[s], target[s], count(t) * brute_taken(i, t, rate[s])) for i, t, s in docs)


def rows(df):
    return sorted((str(r.doc_id), r["size"], r.source_size, r.target, r.taken) for r in df.collect())


def allotted(df):
    return rows(mixture.allot(df).select("row.doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken")))


def test_mixture_query_against_brute_force(spark):
    docs = [(r.doc_id, r.text, r.source) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    found = rows(queries.op13_mixture(spark, SF))
    assert found == brute(docs)
    assert sum({(r[2], r[3]) for r in found} and [t for _, t in {(r[2], r[3]) for r in found}]) == pytest.approx(sum(r[1] for r in found))
    assert all(r[4] <= 3 * r[1] for r in found)


def test_targets_are_cut_and_shared_again(spark):
    rng = random.Random(1)
    for sizes in ({"a": 10, "b": 1000, "c": 5}, {"a": 0, None: 7}, {None: 0}, {f"s{i}": 2**i for i in range(40)}, {f"s{i}": rng.choice([0, 1, 7, 9, 10**12]) for i in range(60)}, {"é": 3, "z": 3, "Z": 3, "\U0001f600": 3, "￿": 3}):
        df = spark.createDataFrame(list(sizes.items()), "source string, source_size long").repartition(3)
        found = {r.source: r.target for r in mixture.targets(df).collect()}
        assert found == pytest.approx(brute_targets(sizes))
        assert all(found[s] <= 3 * n for s, n in sizes.items())


def test_rank_goes_by_code_point_over_many_ranges(spark, monkeypatch):
    names = [f"{i:04d}" for i in range(900)] + ["é", "\U0001f600", "￿"]
    df = spark.createDataFrame([(n,) for n in [*names, None]], "source string").repartition(6)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        found = {r.source: r["rank"] for r in mixture.ranked(df).collect()}
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert found == {n: i for i, n in enumerate([*sorted(names), None])}


def test_mixture_odd_rows(spark, monkeypatch):
    long = "word other\x0bthird " * 100_000
    docs = [(1, "a b c", "x"), (1, "a b c", "x"), (1, "a  b\tc d", "x"), (2, None, "x"), (3, "", None), (None, "p q", None), (None, None, None), (4, long, "y"), (5, "  　", "z"), (6, " \t\n", "empty")]
    schema = "doc_id long, text string, source string, size int, target string, `row` int, copies int, copy int"
    df = spark.createDataFrame([(*d, 1, "t", 2, 3, 4) for d in docs], schema).repartition(4)
    expected = brute(docs)
    assert allotted(df) == expected
    monkeypatch.setattr(mixture, "BROADCAST_BYTES", 0)
    assert allotted(df) == expected
    taken = mixture.mix(df)
    assert sorted(taken.columns) == sorted(df.columns)
    assert sum(r["n"] for r in taken.select(mixture.words(F.col("text")).alias("n")).collect()) == sum(r[4] for r in expected)
    assert {(r["size"], r["row"], r.copies) for r in taken.collect()} == {(1, 2, 3)}
    empty = spark.createDataFrame([], schema)
    assert allotted(empty) == [] and mixture.mix(empty).collect() == []


def test_taken_words_come_near_targets_and_reruns_agree(spark):
    rng = random.Random(2)
    docs = [(i, " ".join(["w"] * rng.randint(1, 60)), "hot" if i % 3 else f"s{i % 7}") for i in range(12_000)]
    df = spark.createDataFrame(docs, "doc_id long, text string, source string")
    found = mixture.allot(df).select("row.source", "row.doc_id", "size", "target", "copies").collect()
    taken, target = Counter(), {}
    for r in found:
        taken[r.source] += r["size"] * r.copies
        target[r.source] = r.target
    assert all(abs(taken[s] - t) < 0.1 * t for s, t in target.items())
    again = mixture.allot(df.repartition(9)).select("row.doc_id", "copies").collect()
    assert sorted((r.doc_id, r.copies) for r in again) == sorted((r.doc_id, r.copies) for r in found)
