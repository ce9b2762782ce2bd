"""Language ID: phrases, scores and choices against a plain longest-match parse; what the sample may hold."""

import math
import random
import re

import numpy as np
import pytest

from roadspeed.llm import language, queries

SF = "/root/testdata/sf0.01"


def plain_symbols(text, alphabet):
    """Each letter as itself or, beyond the alphabet, as three marks; runs of others as one break."""
    out = []
    for c in text.lower():
        if not c.isalpha():
            if out[-1:] != ["_"]:
                out.append("_")
        elif c in alphabet:
            out.append(c)
        else:
            out += [f"{ord(c) >> s & 127}#" for s in (14, 7, 0)]
    return out


def plain_phrases(text, corpus):
    """Longest matches by the strings of a corpus, one phrase after another."""
    joined, n, i = "\x00" + "\x00".join(corpus) + "\x00", 0, 0
    while i < len(text):
        k = 1
        while i + k < len(text) and "\x00" + "\x00".join(text[i : i + k + 1]) + "\x00" in joined:
            k += 1
        i, n = i + k, n + 1
    return n


SAY = {"aa": "abcdé ", "bb": "cdefß ", "zz": "日本語学校東京都 ", "yy": "中文學生國家人民 "}


def made(r, letters, n):
    return "".join(r.choice(letters) for _ in range(n))


@pytest.mark.parametrize(("alphabet", "segment"), [(126, 512), (4, 512), (6, 7), (126, 3)])
def test_phrases_scores_and_choice(alphabet, segment):
    r = random.Random(alphabet + segment)
    train = {g: [made(r, s, 200), made(r, s, 150)] for g, s in SAY.items()}
    model = language.build(train, 10_000, alphabet)
    texts = [made(r, r.choice(list(SAY.values())) + "!", r.randint(1, 300)) for _ in range(25)]
    texts += ["a" * 900, "ab" * 700, train["aa"][0] * 4, "é" + train["bb"][0][20:150] * 5, "x"]
    counts, sizes = language.cross_parse(texts, model, segment)
    corpora = {g: plain_symbols("".join(t + " " for t in ts), model.alphabet) for g, ts in train.items()}
    found = language.predict(texts, model)
    for i, t in enumerate(texts):
        code = plain_symbols(t, model.alphabet)
        assert len(code) == sizes[i]
        expected = [plain_phrases(code, corpora[g]) for g in model.languages]
        assert counts[:, i].tolist() == expected
        expected = [n * math.log(len(corpora[g]) * (len(model.alphabet) + 1)) for n, g in zip(expected, model.languages, strict=True)]  # a place in the sample, and a letter
        best, *rest = sorted(range(len(expected)), key=lambda k: (expected[k], k))
        lang, score = found[i]
        if any(map(str.isalpha, t)):
            assert lang == model.languages[best]
            assert score == pytest.approx(1 - expected[best] / expected[rest[0]])


def test_long_match_over_many_lanes():
    """A phrase that runs through whole lanes: nothing begins in them."""
    model = language.build({"aa": ["ab" * 3000], "bb": ["ba c" * 10]}, 10_000)
    counts, _ = language.cross_parse(["ab" * 2500, "ba" * 3000 + "b"], model)
    assert counts[0].tolist() == [1, 2]


def test_packed_transitions():
    r = np.random.default_rng(3)
    code = r.integers(0, 255, 3000).astype(np.uint8)
    states = language.suffix_automaton(code)
    a = language.pack(states)
    for s in range(0, len(states), 7):
        got, missed = a.step(np.full(256, s, np.int32), np.arange(256, dtype=np.uint8))
        assert set(range(256)) - set(missed.tolist()) == set(states[s])
        assert all(got[c] == q for c, q in states[s].items())


def test_what_is_learned(spark):
    """Languages of long texts only, of many characters, of copies; neither ids nor repeated rows choose the sample."""
    r = random.Random(8)
    rows = [("ll", made(r, "lmno ", 27_000)) for _ in range(3)] + [("en", made(r, "abcd ", 300)) for _ in range(30)] + [("zz", made(r, SAY["zz"], 400)) for _ in range(10)]
    rows += [("cp", "uvw uvw xyz")] * 500 + [(None, "pqrs"), ("nn", None), ("ee", ""), ("dd", "12 34")]
    schema = "doc_id long, lang string, text string, place int, sizes int"
    df = spark.createDataFrame([(i, g, t, 1, 2) for i, (g, t) in enumerate(rows)], schema)
    model = language.fit(df, docs_per_lang=5)
    assert model.languages == ["cp", "en", "ll", "zz"]
    other = spark.createDataFrame([(-i, g, t, 1, 2) for i, (g, t) in enumerate(rows[::-1] + rows[:3])], schema).repartition(3)
    again = language.fit(other, docs_per_lang=5)
    assert all((a.to == b.to).all() and (a.base == b.base).all() for a, b in zip(model.automata, again.automata, strict=True))
    texts = [made(r, "lmno ", 50), made(r, SAY["zz"], 9), "uvw", "abcd", None, "", "1 2", "1 2"]
    found = language.identify(spark.createDataFrame([(i, t, "x", "y") for i, t in enumerate(texts)], "doc_id long, text string, lang_pred string, score string"), model)
    assert [x.lang_pred for x in sorted(found.collect())] == ["ll", "zz", "cp", "en", "und", "und", "und", "und"]
    assert language.identify(df.filter("false"), model).count() == 0
    assert language.fit(df, max_languages=1).languages == ["cp"]


def test_ties_go_to_the_first_name():
    model = language.build({"b": ["xyz"], "a": ["xyz"]}, 100)
    assert language.predict(["xyz"], model) == [("b", 0.0)]  # in the order of the sample, which is that of names
    assert language.predict(["xyz", None], language.build({"a": ["xyz"]}, 100)) == [("a", 1.0), ("und", 0.0)]


def test_query_on_held_out_documents(spark):
    found = {r.doc_id: r for r in queries.op10_language(spark, SF).collect()}
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    assert len(found) == len(docs)
    held = [r for r in docs if found[r.doc_id].held_out and r.lang and re.search(r"[^\W\d_]", r.text or "")]
    assert len(held) > 200
    assert sum(found[r.doc_id].lang_pred == r.lang for r in held) >= 0.98 * len(held)


@pytest.mark.parametrize("vocabulary", [40, 300])
def test_a_small_sample_is_no_handicap(vocabulary):
    """Two languages over one alphabet, 60 words against 6,000."""
    for seed in range(3):
        rng = random.Random(seed)
        words = [["".join(rng.choices("abcdefghijklmnop", [rng.random() + 0.2 for _ in range(16)], k=rng.randint(2, 8))) for _ in range(vocabulary)] for _ in range(2)]
        say = lambda k, n, words=words, rng=rng: " ".join(rng.choices(words[k], k=n))
        model = language.build({"rare": [say(0, 60)], "usual": [say(1, 6000)]}, 30_000)
        for k, name in enumerate(("rare", "usual")):
            found = language.predict([say(k, 80) for _ in range(50)], model)
            assert sum(lang == name for lang, _ in found) >= 45
            assert all(0 <= score <= 1 for _, score in found)


def test_symbols_come_evenly_from_all_texts(spark):
    assert language.even_parts([5, 100, 0, 7, 100], 100) == [5, 44, 0, 7, 44]
    assert language.even_parts([3, 4], 100) == [3, 4] and language.even_parts([], 9) == []
    docs = spark.createDataFrame([(f"text {i} " + "word " * 2000, "xx") for i in range(40)] + [("only one " * 500, "yy"), (None, "xx"), ("no label", None)], "text string, lang string")
    found = language.sample(docs, 20, 1000, 20_000, 10, "text", "lang")
    assert len(found["xx"]) == 20 and {len(t) for t in found["xx"]} == {100}
    assert [len(t) for t in found["yy"]] == [2000]


def test_a_missing_id(spark):
    model = language.build({"xx": ["some words of a text"]}, 1000)
    docs = spark.createDataFrame([(None, "some words"), (None, "some words"), (1, None)], "doc_id long, text string")
    assert sorted((str(r.doc_id), r.lang_pred) for r in language.identify(docs, model).collect()) == [("1", "und"), ("None", "xx"), ("None", "xx")]
