"""Quality, decontamination, PII, language and SimHash against brute force."""

import random
import re
from itertools import combinations

import pytest
import xxhash

from roadspeed.llm import decontaminate, language, pii, quality, simhash

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, lang string, extra string, text2 string"


def docs_of(spark, texts, langs=None):
    langs = langs or ["en"] * len(texts)
    return spark.createDataFrame([(i, t, g, "x", "y") for i, (t, g) in enumerate(zip(texts, langs, strict=True))], DOCS)


def made(seed, n=60, vocabulary=30, words=(0, 120)):
    r = random.Random(seed)
    vocab = [f"w{chr(97 + i % 26)}{i}" for i in range(vocabulary)] + ["É#", "a|b", "x\x1cy", " ", "Ab"]
    return [r.choice([" ", "\n", "\t \n", "  "]).join(r.choice(vocab) for _ in range(r.randint(*words))) for _ in range(n)] + [None, "", " \n "]


def brute_base(text):
    text = text or ""
    words = WORDS.findall(text)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    covered = {i + k for i, w in enumerate(windows) if windows.count(w) > 1 for k in range(3)}
    lines = text.split("\n")
    dup = sum(bool(WORDS.search(x)) and x in lines[:i] for i, x in enumerate(lines))
    n = len(words)
    return n, sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(covered), n < 50 or 100 * len(covered) > 50 * n


def test_quality_base_rules(spark):
    texts = made(1, vocabulary=8)
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(20)], "doc_id long, quality int, toxic int")
    rows = {r.doc_id: r for r in quality.score(docs_of(spark, texts), labels).collect()}
    assert len(rows) == len(texts)
    for i, t in enumerate(texts):
        r = rows[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == brute_base(t)
        assert not (r.base_failed and r.kept)


def test_quality_score_separates(spark):
    r = random.Random(2)
    good = [" ".join(r.choice(["red", "blue", "green", "grey", "pink"]) + str(r.randint(0, 9)) for _ in range(80)) for _ in range(60)]
    bad = [" ".join(r.choice(["BUY!!", "NOW!!", "WIN$$", "CASH$"]) + str(r.randint(0, 9)) for _ in range(80)) for _ in range(60)]
    labels = spark.createDataFrame([(i, 1, 0) for i in range(30)] + [(i, 0, 0) for i in range(60, 90)], "doc_id long, quality int, toxic int")
    rows = {x.doc_id: x for x in quality.score(docs_of(spark, good + bad), labels).collect()}
    assert all(rows[i].score > -0.15 for i in range(60))
    assert all(rows[i].score < -0.15 for i in range(60, 120))


def test_quality_without_rows_or_labels(spark):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert quality.score(docs_of(spark, []), none).count() == 0
    assert [r.kept for r in quality.score(docs_of(spark, [" ".join(map(str, range(60)))]), none).collect()] == [True]


def brute_hits(text, items, window=13):
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    fold = lambda t: word.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    words, hit, found = fold(text), set(), set()
    for item, body in items:
        w = fold(body)
        for i in range(max(1, len(w) - window + 1) if w else 0):
            p = w[i : i + window]
            for j in range(len(words) - len(p) + 1):
                if words[j : j + len(p)] == p:
                    hit |= set(range(j, j + len(p)))
                    found.add(str(item))
    return len(words), len(hit), sorted(found), bool(hit) and 20 * len(hit) >= len(words)


@pytest.mark.parametrize("max_patterns", [500_000, 7])
def test_decontaminate(spark, max_patterns):
    r = random.Random(3)
    vocab = ["the", "of", "Ab", "é", "x9", "zz"]
    items = [(k, " ".join(r.choice(vocab) for _ in range(n))) for k, n in enumerate([1, 2, 3, 12, 13, 14, 30, 5, 0])] + [(6, None), (10, "the, of; AB")]
    items[0] = (0, "rare")
    texts = [" ".join(r.choice(vocab) for _ in range(r.randint(0, 60))) for _ in range(40)] + [None, "", items[6][1].upper(), f"rare\x00rare-{items[5][1]} x"]
    bench = spark.createDataFrame(items, "item_id long, text string")
    out = {x.doc_id: x for x in decontaminate.decontaminate(docs_of(spark, texts), bench, max_patterns=max_patterns).collect()}
    for i, t in enumerate(texts):
        assert (out[i].n_words, out[i].n_hit, out[i]["items"], out[i].contaminated) == brute_hits(t, items), (i, t)


def test_decontaminate_empty(spark):
    none = spark.createDataFrame([], "item_id long, text string")
    assert [r.contaminated for r in decontaminate.decontaminate(docs_of(spark, ["a b", None]), none).collect()] == [False, False]


def brute_spans(text):
    digits = lambda s: re.sub("[^0-9]", "", s)

    def luhn(s):
        return sum(sum(divmod(2 * int(c), 10)) if k % 2 else int(c) for k, c in enumerate(s[::-1])) % 10 == 0

    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) < 256 for p in m[0].split("."))]
    out += [("card", *m.span()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text) if 12 <= len(digits(m[0])) <= 19 and luhn(digits(m[0]))]
    out += [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 9 <= len(digits(m[0])) <= 15]
    return sorted(out, key=lambda s: (s[1], pii.KINDS.index(s[0])))


def test_pii_base_spans():
    r = random.Random(4)
    parts = ["a.b", "@", "x-1", ".", "com", " ", "1.2.3.4", "256", "00012", "4111 1111 1111 1111", "-", "+49 (30) 1234-567", "+", "5", "é", "@x.", "%", "4111-1111-1111-1112", "1", "\n", "("]
    for _ in range(3000):
        text = "".join(r.choice(parts) for _ in range(r.randint(0, 14)))
        assert pii.detect_spans(text) == brute_spans(text), text
    pii.detect_spans("9" * 200_000 + "a" * 200_000 + "@" + "1." * 50_000)


@pytest.mark.parametrize(
    ("text", "kind", "hidden"),
    [
        ("mail jane.doe (at) example (dot) com now", "email", "jane.doe (at) example (dot) com"),
        ("mail jane dot doe at mail dot example dot com.", "email", "jane dot doe at mail dot example dot com"),
        ("é jane[at]example.org", "email", "jane[at]example.org"),
        ("jaнe&#64;example.org ".replace("н", "n"), "email", "jane&#64;example.org"),
        ("jаne@exаmple.com", "email", "jаne@exаmple.com"),
        ("call plus four nine three zero one two three four five six seven ok", "phone", "plus four nine three zero one two three four five six seven"),
        ("card four one one one 1111 one one one one one one one one", "card", "four one one one 1111 one one one one one one one one"),
        ("ip １０.0.0.1", "ip", "１０.0.0.1"),
    ],
)
def test_pii_disguises(text, kind, hidden):
    start = text.index(hidden)
    assert (kind, start, start + len(hidden)) in pii.added_spans(text, pii.detect_spans(text))


def test_pii_clean_text_and_columns(spark):
    texts = ["look at the dot on one of two or three", "Eins zwei. At dot go", None, "", "x a@b.co y", "1.2.3.4"]
    rows = pii.detect(docs_of(spark, texts)).orderBy("doc_id").collect()
    assert [r.spans for r in rows] == ["", "", "", "", "email:2:8", "ip:0:7"]
    df = docs_of(spark, texts)
    hidden = df.select(pii.redact(df["text"]).alias("t")).collect()
    assert [r.t for r in hidden][2:] == [None, "", "x <email> y", "<ip>"]


def test_language_predicts(spark):
    r = random.Random(6)
    say = {"xx": ["foo", "bar", "bazle", "quxt"], "yy": ["lorem", "ipsum", "dolor", "amet"]}
    texts = [" ".join(r.choice(say[g]) for _ in range(40)) for g in ("xx", "yy") * 30] + [None, "", "123 !!", "foo bar " * 20_000]
    langs = ["xx", "yy"] * 30 + [None] * 4
    df = docs_of(spark, texts, langs)
    rows = {x.doc_id: x for x in language.identify(df, language.fit(df.filter("doc_id < 40"))).collect()}
    assert all(rows[i].lang_pred == langs[i] for i in range(60))
    assert [rows[i].lang_pred for i in (60, 61, 62, 63)] == ["und", "und", "und", "xx"]
    assert all(0 <= x.score <= 1 for x in rows.values())
    none = language.fit(df.filter("false"))
    assert {x.lang_pred for x in language.identify(df, none).collect()} == {"und"}


def brute_fp(text):
    words = WORDS.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(words[i : i + 3]).encode(), 42) for i in range(max(1, len(words) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(fps):
    parent = list(range(len(fps)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, j in combinations(range(len(fps)), 2):
        if (fps[i] ^ fps[j]).bit_count() <= 3:
            a, b = sorted((root(i), root(j)))
            parent[b] = a
    return [root(i) for i in range(len(fps))]


@pytest.mark.parametrize("cell", [1024, 2])
def test_simhash(spark, cell):
    r = random.Random(7)
    base = [[f"Word{r.randint(0, 300)}" for _ in range(60)] for _ in range(8)]
    texts = [None, "", "one", "one two", "ONE TWO", "one two three"]
    for b in base:
        for _ in range(8):
            w = list(b)
            for _ in range(r.randint(0, 3)):
                w[r.randrange(len(w))] = f"new{r.randint(0, 99)}"
            texts.append(" ".join(w))
    texts += texts[10:14]
    rows = {x.doc_id: x for x in simhash.near_duplicates(docs_of(spark, texts), cell=cell).collect()}
    fps = [brute_fp(t) for t in texts]
    assert [int(rows[i].fingerprint, 16) for i in range(len(texts))] == fps
    assert [rows[i].component_id for i in range(len(texts))] == brute_components(fps)
    kept = {x.doc_id for x in simhash.keep_one(docs_of(spark, texts)).collect()}
    assert kept == set(brute_components(fps))


def test_simhash_grid_finds_random_pairs(spark):
    r = random.Random(8)
    fps = {r.getrandbits(64) for _ in range(150)}
    for f in list(fps):
        for bits in (1, 2, 3, 4):
            fps.add(f ^ sum(1 << b for b in r.sample(range(64), bits)))
    fps = sorted(fps)
    signed = [(i, f - (1 << 64) if f >> 63 else f) for i, f in enumerate(fps)]
    edges = simhash.link(spark.createDataFrame(signed, "node long, fp long"))
    found = {x.node: x.component for x in simhash.components(edges).collect()}
    assert [found.get(i, i) for i in range(len(fps))] == brute_components(fps)


def test_simhash_empty(spark):
    assert simhash.near_duplicates(docs_of(spark, [])).count() == 0
