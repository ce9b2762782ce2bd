"""Token histograms and the archive converter against brute force and round trips."""

import base64
import hashlib
import random

import pytest

from roadspeed.llm import queries, tokens, warc

SF = "/root/testdata/sf0.001"


def test_histogram_answers(spark):
    r = random.Random(1)
    sizes = [r.choice([0, 1, 5, 5, 900, 1023, 1024, 1025, 3000, 70_000]) for _ in range(200)]
    sums = tokens.suffix_sums(tokens.histogram(spark.createDataFrame([(i, n) for i, n in enumerate(sizes)], "doc_id long, n_tokens long")))
    for row in sums.collect():
        c = row.n_tokens
        assert (row.n_docs, row.docs_from, row.tokens_from) == (sizes.count(c), sum(n >= c for n in sizes), sum(n for n in sizes if n >= c))
        assert (row.docs_total, row.tokens_total, row.tokens_cut) == (200, sum(sizes), sum(min(n, c) for n in sizes))
    limits = [0, 1, 2, 1000, 1024, 5000, 70_000, 10**6]
    for row in tokens.totals_at(sums, limits).collect():
        c = row.context
        assert (row.docs_over, row.tokens_cut, row.tokens_lost) == (sum(n > c for n in sizes), sum(min(n, c) for n in sizes), sum(max(0, n - c) for n in sizes))
    shares = [0.01, 0.25, 0.5, 0.99, 1.0]
    got = {x.q: x.n_tokens for x in tokens.quantiles(sums, shares).collect()}
    ordered = sorted(sizes)
    assert got == {q: ordered[max(0, -int(-q * 200 // 1) - 1)] for q in shares}
    hundred = tokens.suffix_sums(tokens.histogram(spark.createDataFrame([(i, i) for i in range(1, 101)], "doc_id long, n_tokens long")))
    assert {x.q: x.n_tokens for x in tokens.quantiles(hundred, [k / 100 for k in range(1, 101)]).collect()} == {k / 100: k for k in range(1, 101)}


def test_token_query(spark):
    """The query's rows from the lengths of all texts, counted one by one."""
    encode = tokens.encoding(tokens.VOCABULARY).encode_ordinary
    sizes = [len(encode(r.text or "")) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    found = {r.n_tokens: r for r in queries.op3_token_counts(spark, SF).collect()}
    assert set(found) == set(sizes)
    for c, r in found.items():
        expected = (sizes.count(c), sum(n >= c for n in sizes), sum(n for n in sizes if n >= c), len(sizes), sum(sizes), sum(min(n, c) for n in sizes), sum(n <= c for n in sizes))
        assert (r.n_docs, r.docs_from, r.tokens_from, r.docs_total, r.tokens_total, r.tokens_cut, r.docs_up_to) == expected


def test_tokens_of_long_and_repeated_rows(spark):
    rows = [(1, "word " * 200_000, 5, 0, "b")] * 2 + [(2, None, 5, 0, "b")]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_docs int, n_tokens int, block string")
    found = sorted(tuple(r)[:2] for r in tokens.length_report(df).collect())
    assert found == [(0, 1), (len(tokens.encoding(tokens.VOCABULARY).encode_ordinary("word " * 200_000)), 2)]


def test_histogram_of_no_documents(spark):
    sums = tokens.suffix_sums(tokens.histogram(spark.createDataFrame([], "doc_id long, n_tokens long")))
    assert sums.count() == 0
    assert [tuple(r) for r in tokens.totals_at(sums, [0, 10]).orderBy("context").collect()] == [(0, 0, 0, 0), (10, 0, 0, 0)]
    assert tokens.totals_at(sums, []).count() == tokens.quantiles(sums, [0.5]).count() == 0


def test_token_lengths(spark):
    encode = tokens.encoding(tokens.VOCABULARY)
    texts = ["Hello wörld <|endoftext|>", None, "", "a" * 5000, "x\n\n y"]
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, n_tokens int")
    rows = {r.doc_id: r.n_tokens for r in tokens.lengths(df).collect()}
    assert rows == {i: len(encode.encode_ordinary(t or "")) for i, t in enumerate(texts)}
    assert encode.decode(encode.encode_ordinary(texts[0])) == texts[0]
    assert tokens.length_report(df.filter("false")).count() == 0


@pytest.mark.parametrize("version", [1, 2])
def test_arc_versions(version):
    bodies = [warc.http_response(b, {"X-Page-Id": str(i)}) for i, b in enumerate([b"", b"a\nb", b"http://x 1 2 3 4\n", b"\n\n\n", "é".encode()])]
    data = warc.arc_head(version) + b"".join(warc.arc_record(version, f"http://x/{i}", b, date="19990102030405") for i, b in enumerate(bodies))
    rows = list(warc.parse_arc(data))
    assert [r["body"] for r in rows] == bodies
    assert [r["url"] for r in rows] == [f"http://x/{i}" for i in range(5)]
    record = warc.warc_record(rows[1])
    fields, block = next(warc.parse_warc(record))
    assert block == bodies[1]
    assert fields["warc-date"] == "1999-01-02T03:04:05Z"
    assert fields["warc-payload-digest"] == warc.sha1_base32(b"a\nb")
    assert fields["warc-type"] == "response"


def test_arc_damage():
    good = warc.arc_head(1) + warc.arc_record(1, "http://x", b"abc")
    with pytest.raises(ValueError, match="cut short"):
        list(warc.parse_arc(good[:-3]))
    with pytest.raises(ValueError, match="header line"):
        list(warc.parse_arc(warc.arc_head(2) + warc.arc_record(1, "http://x", b"abc")))


def test_round_trip(spark, tmp_path):
    long = "é" * 500
    html = [None, "", long, long, "a" * 999, "a" * 999, "a" * 1000, "a" * 1000, "line\r\n\r\nWARC/1.1\r\nContent-Length: 3\r\n\r\nx" + long, long, "\n\r\n\n", "\r\n"]
    pages = spark.createDataFrame([(i, f"http://x y/{i}\n" if i else None, h, "extra") for i, h in enumerate(html)], "page_id long, url string, html string, sha1 string")
    rows = {r.page_id: r for r in warc.convert_pages(spark, pages.repartition(3), str(tmp_path / "w")).collect()}
    assert len(rows) == len(html)
    for i, h in enumerate(html):
        data = (h or "").encode()
        same = [j for j, x in enumerate(html) if x == h]
        revisit = len(data) >= 1000 and i != max(same)
        r = rows[i]
        assert (r.payload_bytes, r.record_type, r.refers_to) == (len(data), "revisit" if revisit else "response", max(same) if revisit else None)
        assert r.payload_digest == warc.sha1_base32(data)
    stored = {r.page_id: r.payload for r in warc.read_warc(spark, str(tmp_path / "w")).collect()}
    assert all(stored[i] is None or bytes(stored[i]) == (h or "").encode() for i, h in enumerate(html))
    hexed = warc.read_warc(spark, str(tmp_path / "w")).select(warc.hex_digest("payload_digest").alias("d")).first().d
    assert len(hexed) == len(hashlib.sha1().hexdigest())


def test_no_pages(spark, tmp_path):
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    assert warc.convert_pages(spark, pages, str(tmp_path / "w")).count() == 0


def test_repeated_rows_and_missing_ids(spark, tmp_path):
    """Each row gives one row, whatever is repeated; a page without an id is a response only where no page with one has its payload."""
    x, y, z = "x" * 1200, "y" * 1500, "z" * 1000
    rows = [(3, x), (5, x), (5, x), (7, y), (None, x), (None, z), (None, z), (9, "short"), (9, "short"), (8, "short"), (None, None), (5, y)]
    df = spark.createDataFrame([(i, f"http://a/{i}", h, "n", "b") for i, h in rows], "page_id long, url string, html string, first string, sha1 string")
    found = warc.convert_pages(spark, df, str(tmp_path / "w")).collect()
    assert len(found) == len(rows)
    key = lambda r: tuple(str(v) for v in r)
    digest = lambda h: hashlib.sha1((h or "").encode()).hexdigest()
    expected = []
    for i, h in rows:
        top = max((j for j, g in rows if g == h and j is not None), default=None)
        revisit = len(h or "") >= 1000 and i != top
        expected.append((i, len(h or ""), digest(h), "revisit" if revisit else "response", top if revisit else None))
    got = [(r.page_id, r.payload_bytes, base64.b32decode(r.payload_digest[5:]).hex(), r.record_type, r.refers_to) for r in found]
    assert sorted(got, key=key) == sorted(expected, key=key)


def test_ids_of_any_type_come_back(spark):
    body = "x" * 1500
    rows = [("a/b c", body), ("é\n1", body), ("", "short"), ("10", "y" * 2000), ("9", "y" * 2000), (None, "no id")]
    found = {r.page_id: (r.record_type, r.refers_to) for r in warc.convert_pages(spark, spark.createDataFrame([(i, "http://a/", h) for i, h in rows], "page_id string, url string, html string")).collect()}
    assert found == {"a/b c": ("revisit", "é\n1"), "é\n1": ("response", None), "": ("response", None), "10": ("revisit", "9"), "9": ("response", None), None: ("response", None)}
    small = spark.createDataFrame([(10, "u", "y" * 2000), (9, "u", "y" * 2000)], "page_id int, url string, html string")
    out = warc.convert_pages(spark, small)
    assert dict(out.dtypes)["page_id"] == "int" and {r.page_id: r.refers_to for r in out.collect()} == {10: None, 9: 10}
