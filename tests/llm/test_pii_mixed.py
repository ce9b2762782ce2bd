"""Disguises with few digit names, mixed forms and endings of any country; prose stays."""

import pytest

from roadspeed.llm import pii, queries


@pytest.mark.parametrize(
    ("text", "kind", "hidden"),
    [
        ("host 192 dot 168 dot 0 dot 1 is up", "ip", "192 dot 168 dot 0 dot 1"),
        ("host 10 dot zero dot 0 dot 1", "ip", "10 dot zero dot 0 dot 1"),
        ("call +49 171 two three 5 6 7 8 9 now", "phone", "+49 171 two three 5 6 7 8 9"),
        ("call plus 49 171 2345678 now", "phone", "plus 49 171 2345678"),
        ("card 4111 1111 1111 111 one", "card", "4111 1111 1111 111 one"),
        ("é jane [at] example dot com now", "email", "jane [at] example dot com"),
        ("é jane at example [dot] com now", "email", "jane at example [dot] com"),
        ("jane dot doe [at] mail.example dot com", "email", "jane dot doe [at] mail.example dot com"),
        ("jane at example&#46;org", "email", "jane at example&#46;org"),
        ("jane at example dot cz", "email", "jane at example dot cz"),
        ("jane at example dot xyz", "email", "jane at example dot xyz"),
        ("jane (at) example dot museum", "email", "jane (at) example dot museum"),
        ("jane@example dot museum", "email", "jane@example dot museum"),
    ],
)
def test_disguises(text, kind, hidden):
    start = text.index(hidden)
    assert (kind, start, start + len(hidden)) in pii.added_spans(text, pii.detect_spans(text))


@pytest.mark.parametrize("text", ["look at the dot so we see", "one of 2 dot 3", "see a@b.co dot then", "in 2019 one of 1,000 or two", "at version 1 dot 2 dot 3", "300 dot 1 dot 1 dot 1", "call +1 (848) 555-1373 Un mot", "look at the dot com", "he works at home dot net", "we were at stake dot org", "Meet at a dot io", "jane at the dot com"])
def test_prose(text):
    assert pii.added_spans(text, pii.detect_spans(text)) == []


def test_disguises_through_the_query(spark, tmp_path):
    """Added spans of a planted table, through the query; clean texts keep their base spans alone."""
    rows = [(1, "write to jane at example dot com now"), (2, "he works at home dot net"), (3, "host 192 dot 168 dot 0 dot 1"), (4, "a@b.co"), (5, None), (6, "call plus 49 171 2345679")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    found = {r.doc_id: (r.n_added, r.spans, r.n_email) for r in queries.op4_pii(spark, str(tmp_path)).collect()}
    assert found == {1: (1, "email:9:32", 0), 2: (0, "", 0), 3: (1, "ip:5:28", 0), 4: (0, "email:0:6", 1), 5: (0, "", 0), 6: (1, "phone:5:24", 0)}
