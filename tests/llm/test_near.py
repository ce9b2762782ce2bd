"""Near copies of the pipeline against Jaccard similarities of all pairs."""

import random
from itertools import combinations

import numpy as np
import pandas as pd
import pytest

import corpus_pipeline
from roadspeed.llm import near

SF = "/root/testdata/sf0.001"


def brute_set(text):
    words = (text or "").encode().lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def brute_kept(docs):
    """docs: id and text, in order of ids."""
    sets, parent = [brute_set(t) for _, t in docs], list(range(len(docs)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, j in combinations(range(len(docs)), 2):
        if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
            a, b = sorted((root(i), root(j)))
            parent[b] = a
    return {docs[root(i)][0] for i in range(len(docs))}


def test_near_copies_of_the_stage(spark):
    """Copies with a few words changed differ in more than three bits, yet only the first of each stays; half copies stay."""
    r = random.Random(5)
    texts = [None, "", "one two", "ONE  two", "one two three"]
    for _ in range(12):
        base = [f"Word{r.randint(0, 900)}" for _ in range(300)]
        for edits in (0, 1, 2, 4, 5, 6, 7, 9, 60):
            words = list(base)
            for k in r.sample(range(300), edits):
                words[k] = f"new{r.randint(0, 99999)}"
            texts.append(" ".join(words))
    docs = list(enumerate(texts))
    rows = corpus_pipeline.near_dedup(spark, spark.createDataFrame([(i, t, "x") for i, t in docs], "doc_id long, text string, source string"), SF)
    kept = {x.doc_id for x in rows.collect()}
    assert kept == brute_kept(docs)
    assert {5 + 9 * k for k in range(12)} <= kept and not any(6 + 9 * k in kept for k in range(12))


def test_near_copies_of_the_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert {x.doc_id for x in near.keep_one(docs).collect()} == brute_kept(sorted((x.doc_id, x.text) for x in docs.collect()))


@pytest.mark.parametrize("texts", [[], ["a b c d e f g"]])
def test_near_without_pairs(spark, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert near.keep_one(docs).count() == len(texts)


def test_rows_that_are_odd(spark):
    """Missing and repeated ids, repeated rows, ties and clashing columns: each different text of no near copy stays."""
    r = random.Random(11)
    long = [" ".join(f"w{r.randint(0, 9**6)}" for _ in range(60)) for _ in range(6)]
    rows = [(None, long[0]), (None, long[0] + " more"), (7, long[0]), (7, long[1]), (7, long[2]), (7, long[2]), (None, long[3]), (None, long[3]), (None, long[4]), (9, None), (3, ""), (None, " \n")]
    rows += [(8, long[5] + " x"), (8, long[5] + " y")]
    docs = spark.createDataFrame([(i, t, "n", "r", "m") for i, t in rows], "doc_id long, text string, node string, row string, _mark_of_words string")
    kept = near.keep_one(docs)
    assert kept.columns == docs.columns
    got = sorted(((x.doc_id, x.text) for x in kept.collect()), key=str)
    tied = next(x for x in got if x[0] == 8)
    assert tied in rows
    assert got == sorted([(7, long[0]), (7, long[1]), (7, long[2]), (None, long[3]), (None, long[4]), (3, ""), tied], key=str)
    again = near.keep_one(docs.repartition(7)).collect()
    assert sorted(((x.doc_id, x.text) for x in again), key=str) == got


@pytest.mark.parametrize("cell", [8, 1024])
def test_a_large_group_of_near_copies(spark, cell):
    """Copies of one text that are less like each other, and copies of a copy: linked through others, with whole or dealt cells."""
    r = random.Random(3)
    base = [f"w{r.randint(0, 9**6)}" for _ in range(200)]

    def edited(words, n):
        words = list(words)
        for k in r.sample(range(len(words)), n):
            words[k] = f"e{r.randint(0, 9**6)}"
        return words

    copies = [edited(base, r.choice([1, 2, 4, 5, 6, 9])) for _ in range(60)]
    chain = [copies[0]]
    for _ in range(12):
        chain.append(edited(chain[-1], 3))
    docs = list(enumerate(" ".join(w) for w in [base, *copies, *chain, *(edited(base, 40) for _ in range(10))]))
    r.shuffle(docs)
    df = spark.createDataFrame(docs, "doc_id long, text string")
    assert {x.doc_id for x in near.keep_one(df, cell=cell).collect()} == brute_kept(sorted(docs))


def test_pairs_that_reach_the_comparison():
    """A group around one text is settled by its hub; of 400 others that are not similar no square of pairs is left."""
    r = random.Random(4)
    base = [f"w{r.randint(0, 9**6)}" for _ in range(200)]
    texts = []
    for _ in range(400):
        words = list(base)
        for k in r.sample(range(200), 9):  # to the base some 0.65, to each other some 0.45
            words[k] = f"e{r.randint(0, 9**6)}"
        texts.append(" ".join(words))
    fps = near._keys(pd.Series(texts))["fp"].to_numpy().view(np.uint64)
    sets = [near.sketch_of(near.shingle_hashes(t)) for t in texts]
    root = np.arange(400)
    a, b = near.likely_pairs(root, np.full(400, -1), fps, sets, np.zeros(400, bool))
    similar = {(i, j) for i, j in combinations(range(400), 2) if 5 * len(brute_set(texts[i]) & brute_set(texts[j])) >= 4 * len(brute_set(texts[i]) | brute_set(texts[j]))}
    assert similar == set(zip(a.tolist(), b.tolist(), strict=True))
    whole = [s[:1] for s in sets]
    left, right = near.likely_pairs(root, np.full(400, -1), np.zeros(400, np.uint64), [whole[0]] * 400, root % 2 == 1)
    assert len(left) == 200 * 200
    assert ((left + right) % 2 == 1).all()


def test_estimates_of_long_sets():
    """Sets beyond the sketch: what is similar is not lost, what is far from it goes."""
    r = np.random.default_rng(5)
    pairs = []
    for similarity in (0.8, 0.85, 0.95, 0.6, 0.5):
        for n in (300, 2000, 20_000):
            both = r.integers(0, 1 << 63, n).astype(np.uint64) * np.uint64(2)
            own = r.integers(0, 1 << 63, (2, int(n * (1 - similarity) / similarity / 2))).astype(np.uint64) * np.uint64(2) + np.uint64(1)
            pairs.append((similarity, [np.unique(np.concatenate([both, x])) for x in own]))
    for similarity, sets in pairs:
        a, _ = near.likely_pairs(np.arange(2), np.array([-1, -1]), np.zeros(2, np.uint64), [near.sketch_of(s) for s in sets], np.zeros(2, bool))
        assert len(a) == (similarity >= 0.8)


def test_minima_are_those_of_the_functions():
    s = near.shingle_hashes("a b c d e f g h")
    least = near.minima(s)
    for f in range(0, near.BANDS * near.ROWS, 7):
        assert int(least[f]) == min((int(h) ^ int(near._MASKS[f, 0])) * int(near._FACTORS[f, 0]) % 2**64 for h in s)
