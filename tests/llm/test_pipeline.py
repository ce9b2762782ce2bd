"""The pipeline against brute force, stage by stage."""

import re

import pytest
import sentencepiece

import corpus_pipeline
from roadspeed.llm import pieces

from .test_near import brute_kept
from .test_text_operators import brute_hits

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def steps(spark):
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        out.append(docs)
        docs = stage(spark, docs, SF)
        docs = spark.createDataFrame(docs.collect(), docs.schema)
    return [x.collect() for x in [*out, docs]]


def test_stages(spark, steps):
    documents, spoken, single, clean, masked, tokens = steps
    columns = set(documents[0].asDict())
    assert all(set(rows[0].asDict()) == columns for rows in (spoken, single, clean, masked))
    assert {r.doc_id for r in spoken} == {r.doc_id for r in documents if r.text and any(map(str.isalpha, r.text))}
    assert {r.doc_id for r in single} == brute_kept(sorted((r.doc_id, r.text) for r in spoken))
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    sample = [r for r in single if len(r.text) < 1500]
    kept = {r.doc_id for r in clean}
    assert all((r.doc_id in kept) != brute_hits(r.text, items)[3] for r in sample)
    email = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
    assert len(masked) == len(clean) == len(tokens)
    assert any(email.search(r.text) for r in clean)
    assert not any(email.search(r.text) for r in masked)
    assert all(r.n_chars == len(r.text) for r in masked)
    sp = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
    text = {r.doc_id: r.text for r in masked}
    assert all(list(r.ids) == sp.encode(text[r.doc_id]) for r in tokens)


@pytest.mark.parametrize("rows", ["odd", "none"])
def test_odd_rows(spark, rows):
    """Nulls in any column, empty and very long texts, repeated rows and ids, clashing columns, empty tables: no stage fails, clean documents stay."""
    words = " ".join(r.text for r in spark.read.parquet(f"{SF}/documents.parquet").filter("lang = 'en'").limit(12).collect()).split()
    clean = [" ".join(words[k : k + 120]) for k in range(0, 1200, 120)]
    table = [(1, clean[0], "en", None, None), (1, clean[0], "en", None, None), (1, clean[1], None, "s", 5), (None, clean[2], "en", "s", 5), (None, None, None, None, None)]
    table += [(3, "", "en", "s", 0), (4, " ".join(words * 20), "en", "s", 9), (5, "12 34", "en", "s", 1), (6, clean[3] + " me at x dot com", "en", "s", 1)]
    table = [(*r, "_k", "k", "i") for r in table]
    schema = "doc_id long, text string, lang string, source string, n_chars long, _language string, _kept_id string, ids string"
    docs = spark.createDataFrame(table if rows == "odd" else [], schema)
    first = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, first if name == "language_id" else docs, SF)
        assert docs.columns == first.columns
        docs = spark.createDataFrame(docs.collect(), docs.schema)
    tokens = corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect()
    expected = [(1, 1), (1, 1), (4, 1), (6, 1), (None, 1)] if rows == "odd" else []
    assert sorted(((r.doc_id, 1) for r in docs.collect()), key=str) == sorted(expected, key=str)
    assert sorted((r.doc_id or 0, r.n_tokens) for r in tokens) == sorted((r.doc_id or 0, len(pieces.pieces(pieces.MODEL).sp.encode(r.text))) for r in docs.collect())


def test_run(spark, steps):
    assert sorted((r.doc_id, r.n_tokens) for r in corpus_pipeline.run(spark, SF).collect()) == sorted((r.doc_id, r.n_tokens) for r in steps[-1])
