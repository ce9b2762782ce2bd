"""Rows that are odd: nulls, empty and very long texts, ties, repeated rows, empty tables, clashing columns; scores against brute force."""

import math
import random
import re
from collections import Counter

import pytest

from roadspeed.llm import decontaminate, quality, queries, simhash

from .test_text_operators import brute_base, brute_components, brute_fp, brute_hits

SF = "/root/testdata/sf0.001"


def brute_scores(docs, trusted, n_buckets, kappa):
    """docs: id, text. Mean log ratio of smoothed bucket counts, a document's own counts taken out."""
    grams = []
    for _, t in docs:
        words = (t or "").encode().split()
        grams.append(Counter(quality.buckets(words, n_buckets).tolist()) if words else Counter())
    raw, target = Counter(), Counter()
    for (i, _), g in zip(docs, grams, strict=True):
        raw.update(g)
        if i in trusted:
            target.update(g)
    n_raw, n_target, out = raw.total(), target.total(), []
    for (i, _), g in zip(docs, grams, strict=True):
        total = 0.0
        for b, n in g.items():
            other = target[b] - (n if i in trusted else 0)
            total += n * (math.log(other + kappa) - math.log((raw[b] - n) * (n_target / n_raw) + kappa))
        out.append(total / g.total() if g and n_target else 0.0)
    return out


def test_quality_query_against_brute_force(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    trusted = {r.doc_id for r in spark.read.parquet(f"{SF}/labels.parquet").filter("quality = 1").collect()}
    found = {r.doc_id: r for r in queries.op1_quality(spark, SF).collect()}
    assert len(found) == len(docs)
    for (i, t), s in zip(docs, brute_scores(docs, trusted, 1 << 16, 3.0), strict=True):
        assert found[i].score == pytest.approx(s, abs=1e-9)
        assert found[i].kept == (not brute_base(t)[-1] and found[i].score >= -0.15)
    assert 0 < sum(r.kept for r in found.values()) < len(docs)


def test_quality_odd_rows(spark, monkeypatch):
    long = "word other " * 150_000
    rows = [(1, "a b c"), (1, "a b c"), (None, "a b"), (2, None), (3, ""), (4, long)]
    df = spark.createDataFrame([(i, t, 5, True) for i, t in rows], "doc_id long, text string, n_words int, _trusted boolean")
    labels = spark.createDataFrame([(1, 1, 0), (1, 1, 0), (1, 0, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    found = quality.score(df, labels).collect()
    expected = brute_scores(rows, {1}, 1 << 16, 3.0)
    assert sorted((str(r.doc_id), r.n_words, round(r.score, 9)) for r in found) == sorted((str(i), len((t or "").split()), round(s, 9)) for (i, t), s in zip(rows, expected, strict=True))
    assert brute_base("a b c")[:-1] == tuple(next(r for r in found if r.doc_id == 1))[1:6]
    monkeypatch.setattr(quality, "BROADCAST_IDS", 0)
    assert sorted(map(str, quality.score(df, labels).collect())) == sorted(map(str, found))


def test_decontaminate_odd_rows(spark):
    r = random.Random(2)
    words = [f"w{k}" for k in range(300)]
    item = " ".join(words[:40])
    items = [("a", item), ("a", item), (None, " ".join(words[100:120])), ("b", " ".join(words[100:113])), ("c", None), ("d", "?"), ("e", "w299")]
    long = " ".join(r.choice(words[:150]) for _ in range(200_000)) + " " + item
    rows = [(1, item.upper()), (1, item.upper()), (None, " ".join(words[95:125])), (2, None), (3, ""), (4, long), (5, "x w299 y")]
    df = spark.createDataFrame([(i, t, "i", 1) for i, t in rows], "doc_id long, text string, items string, n_words int")
    bench = spark.createDataFrame([(i, t, "x") for i, t in items], "item_id string, text string, doc_id string")
    expected = []
    for i, t in rows:
        n_words, n_hit, _, bad = brute_hits(t, [(f"{k}", b) for k, (_, b) in enumerate(items)])
        named = brute_hits(t, [(k, b) for k, b in items if k is not None])[2]
        expected.append((str(i), n_words, n_hit, sorted(named), bad))
    for limit in (500_000, 7):
        found = decontaminate.decontaminate(df, bench, max_patterns=limit).collect()
        assert sorted((str(x.doc_id), x.n_words, x.n_hit, list(x["items"]), x.contaminated) for x in found) == sorted(expected)
    assert decontaminate.decontaminate(df.filter("false"), bench).count() == 0
    assert all(x.n_hit == 0 for x in decontaminate.decontaminate(df, bench.filter("false")).collect())


@pytest.mark.parametrize("kind", ["long", "string"])
def test_simhash_odd_rows(spark, kind):
    """Ids of any kind, missing and repeated ones; a component's id is its smallest."""
    r = random.Random(3)
    base = [" ".join(f"w{r.randint(0, 99999)}" for _ in range(80)) for _ in range(3)]
    rows = [(5, base[0]), (7, base[0].upper()), (None, base[0]), (7, base[1]), (7, base[1]), (None, base[2]), (3, None), (None, " "), (2, "long " * 200_000)]
    df = spark.createDataFrame([(None if i is None else i if kind == "long" else str(i), t, 0, 0, "n") for i, t in rows], f"doc_id {kind}, text string, fp long, component_id int, node string")
    roots = brute_components([brute_fp(t) for _, t in rows])
    found = simhash.near_duplicates(df).collect()
    expected = []
    for k, (i, t) in enumerate(rows):
        ids = [j for m, (j, _) in enumerate(rows) if roots[m] == roots[k] and j is not None]
        expected.append((str(i), f"{brute_fp(t):016x}", str(min(ids)) if ids else "None"))
    assert sorted((str(x.doc_id), x.fingerprint, str(x.component_id)) for x in found) == sorted(expected)
    kept = simhash.keep_one(df)
    assert kept.columns == df.columns
    first = {}
    for k, (i, t) in enumerate(rows):
        if roots[k] not in first or (i is None, i or 0) < (first[roots[k]][0] is None, first[roots[k]][0] or 0):
            first[roots[k]] = (i, t)
    assert sorted(str((x.doc_id, x.text)) for x in kept.collect()) == sorted(str((None if i is None else i if kind == "long" else str(i), t)) for i, t in first.values())


def test_word_patterns():
    assert re.fullmatch(r"[^\x20\x09-\x0D]+", "é\x1c")  # the words of the contracts part at ASCII white space only
