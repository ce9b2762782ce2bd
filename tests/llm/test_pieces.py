"""SentencePiece against the public library: ids of the byte-pair model, best scores of the same pieces read as a unigram model."""

import random

import numpy as np
import pytest
import sentencepiece

from roadspeed.llm import pieces

with open(pieces.MODEL, "rb") as f:
    PROTO = f.read()


def as_unigram(proto: bytes) -> bytes:
    """The same vocabulary with the model type set to unigram; nothing is trained."""
    out = b""
    for number, start, end, value in pieces._fields(proto):
        part = proto[start:end]
        if number == 2:
            at = next(e for k, s, e, v in pieces._fields(value) if k == 3)
            body = bytearray(value)
            body[at - 1] = 1
            part = part[: len(part) - len(value)] + bytes(body)
        out += part
    return out


def text_of(seed, n):
    r = random.Random(seed)
    words = ["the", "quick", "brönn", "fox", "  ", "\n", "42", "日本語", "😀", "internationalisation", "▁", "aaaaaaaaaaaaaaaaaaaaaaaa", "x.y", "\t"]
    return " ".join(r.choice(words) for _ in range(n))


def run_scan(p, text, chunk):
    parts = list(p.chunks(p.sp.normalize(text), chunk))
    matrices = [p.transfer(t, lead, n) for _, lead, n, t in parts]
    found = pieces.states(matrices, 0, 0)
    whole = matrices[0]
    for m in matrices[1:]:
        whole = pieces.combine(whole, m)
    ids = [i for (_, lead, n, t), (s, e) in zip(parts, found, strict=True) for i in p.trace(t, lead, n, s, e)]
    return ids, whole[0, 0]


@pytest.mark.parametrize("chunk", [20, 33, 100, 10_000])
def test_merges_match_the_library(chunk):
    p = pieces.Pieces(PROTO)
    assert p.merges
    for seed in range(6):
        text = text_of(seed, 80) + (" " if seed % 2 else "")
        assert run_scan(p, text, chunk)[0] == p.sp.encode(text)


@pytest.mark.parametrize("chunk", [20, 50, 10_000])
def test_unigram_matches_the_library(chunk):
    proto = as_unigram(PROTO)
    assert pieces.model_type(proto) == 1
    p = pieces.Pieces(proto)
    library = sentencepiece.SentencePieceProcessor(model_proto=proto)

    def score(ids):
        total, i = 0.0, 0
        while i < len(ids):
            b = p.bytes.get(ids[i])
            if b is None:
                total, i = total + library.get_score(ids[i]), i + 1
            else:
                total, i = total + p.unknown, i + (1 if b < 0xC0 else 2 if b < 0xE0 else 3 if b < 0xF0 else 4)
        return total

    for seed in range(4):
        text = text_of(seed, 60)
        ids, best = run_scan(p, text, chunk)
        assert p.sp.decode(ids) == text.replace("▁", " ")
        assert score(ids) == pytest.approx(best) == pytest.approx(score(library.encode(text)))


def test_combine_is_associative():
    r = np.random.default_rng(1)
    a, b, c = (np.where(r.random((5, 5)) < 0.3, -np.inf, r.random((5, 5))) for _ in range(3))
    assert np.allclose(pieces.combine(pieces.combine(a, b), c), pieces.combine(a, pieces.combine(b, c)))


def test_encode(spark):
    texts = [None, "", " ", text_of(1, 30), text_of(2, 3000), text_of(2, 3000), "z" * 30_000, text_of(3, 9000)]
    rows = [(i, t, "x") for i, t in enumerate(texts)] + [(4, texts[4], "again")]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    out = pieces.encode(df, giant=5_000, chunk=700, keep=("text",), check=True)
    found = out.withColumn("back", pieces.decode(out["ids"])).collect()
    assert len(found) == len(rows)
    sp = sentencepiece.SentencePieceProcessor(model_proto=PROTO)
    for r in found:
        t = r.text or ""
        assert list(r.ids) == sp.encode(t)
        assert r.n_tokens == len(r.ids)
        assert r.back == t.replace("▁", " ")
        assert r.round_trip
        assert (r.n_chunks > 1) == (len(t) > 5_000)
    assert pieces.encode(df.filter("false")).count() == 0


def mixed(seed, n, letters):
    r = random.Random(seed)
    return "".join(r.choice(letters) for _ in range(n))


@pytest.mark.parametrize("letters", ["ab", "aA▁ ", "the inrs", "日本語学校のはをにが東京都", "0123456789abcdef", "ёжик <0x41>", "ééa😀"])
def test_merges_without_blanks_to_cut_at(letters):
    """Any place may be a cut: the states hold the tokens that may stand there, and one path is left over."""
    p = pieces.Pieces(PROTO)
    for seed in range(12):
        text = mixed(seed, 240, letters)
        ids, best = run_scan(p, text, 17)
        assert ids == p.sp.encode(text)
        assert best == 0
    p.left_alone.clear()


def test_matrices_hold_alternatives():
    """At a cut inside a word many tokens may stand; the scan rules all but one path out."""
    p = pieces.Pieces(PROTO)
    text = p.sp.normalize("internationalisation of governmental representatives " * 3)
    parts = list(p.chunks(text, 24))
    matrices = [p.transfer(t, lead, n) for _, lead, n, t in parts]
    assert max(max(m.shape) for m in matrices) > 3
    assert sum(int((m == 0).sum()) for m in matrices) > len(matrices)


def test_bytes_carried_by_a_long_text_without_blanks():
    p = pieces.Pieces(PROTO)
    text = mixed(1, 120_001, "日本語学校のはをにが東京都駅前で食べ物")
    normal = p.sp.normalize(text)
    parts = list(p.chunks(normal, pieces.CHUNK))
    assert len(parts) == 7
    assert sum(len(t) for _, _, _, t in parts) <= 1.1 * len(normal)
    assert run_scan(p, text, pieces.CHUNK)[0] == p.sp.encode(text)


def test_query_takes_the_scan_for_all_but_short_documents(spark):
    """Every document above a small limit goes through the scan, whole table."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    sp = sentencepiece.SentencePieceProcessor(model_proto=PROTO)
    rows = pieces.encode(docs, giant=600, chunk=250, keep=("text",), check=True).collect()
    assert len(rows) == docs.count()
    assert sum(r.n_chunks > 1 for r in rows) == sum(len(r.text or "") > 600 for r in rows) > 100
    for r in rows:
        assert list(r.ids) == sp.encode(r.text or "")
        assert r.round_trip


def test_stretches_are_cut_at_safe_places():
    p = pieces.Pieces(PROTO)
    for text in (p.sp.normalize(text_of(5, 200)), "a", "😀", "zz"):
        found, at = p.stretches_of(text), 0
        assert "".join(found) == text
        ends = set(np.cumsum([len(x) for x in found]).tolist())
        assert ends == {i for i in range(1, len(text) + 1) if p.safe(text, i)}


def test_chunks_of_one_document_are_many_tasks(spark):
    p = pieces.Pieces(PROTO)
    text = text_of(7, 20_000)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        stages = set(spark.sparkContext.statusTracker().getJobIdsForGroup(None))
        found = pieces.scan(spark.createDataFrame([("k", text)], "key string, text string"), chunk=2_000).first()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    tracker = spark.sparkContext.statusTracker()
    jobs = [tracker.getJobInfo(j) for j in set(tracker.getJobIdsForGroup(None)) - stages]
    tasks = [s.numTasks for j in jobs if j for i in j.stageIds if (s := tracker.getStageInfo(i))]
    assert list(found.ids) == p.sp.encode(text)
    assert found.n_chunks == len(list(p.chunks(p.sp.normalize(text), 2_000)))
    assert max(tasks) >= 4
