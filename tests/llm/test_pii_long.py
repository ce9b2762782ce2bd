"""PII on long texts: time in proportion to the text; plain prose; odd tables."""

import time

import pytest

from roadspeed.llm import pii


@pytest.mark.parametrize("unit", ["a dot ", "a@b.co ", "a at ", "one two ", "x [at] ", "+1 ", "1.2.3.", "4111 ", "at dot ", "a.", "plus one dot ", "&#64;", "aа at b dot c ", "    ", "\t[dot]", "@ dot "])
def test_time_in_proportion(unit):
    def seconds(n):
        text = unit * n + "x [at] y dot com"
        began = time.perf_counter()
        pii.added_spans(text, pii.detect_spans(text))
        return time.perf_counter() - began

    seconds(100)
    small, large = seconds(4_000), seconds(32_000)
    assert large < 1 + 24 * small


@pytest.mark.parametrize(
    ("text", "spans"),
    [
        ("we meet at noon dot in the", []),
        ("he was at home point me then", []),
        ("write to jane at corp dot in", [("email", 9, 28)]),
        ("write to jane at corp dot in.", [("email", 9, 28)]),
        ("..a dot b at c dot com", [("email", 8, 22)]),
        (".jane at x dot com", []),
        ("a at b dot com at d dot org", [("email", 0, 14)]),
        ("jane dot doe at mail dot example dot com today", [("email", 0, 40)]),
        ("x at y dot com, x at y dot com", [("email", 0, 14), ("email", 16, 30)]),
    ],
)
def test_addresses(text, spans):
    assert pii.added_spans(text, pii.detect_spans(text)) == spans


def test_odd_tables(spark):
    """Repeated rows give repeated results, other columns are left out, an empty table gives none; a long text is read to its end."""
    long = "word " * 300_000 + "a@b.co x [at] y dot org"
    rows = [(1, "a@b.co")] * 2 + [(None, "1.2.3.4"), (3, None), (4, ""), (5, long)]
    df = spark.createDataFrame([(i, t, "s", 7) for i, t in rows], "doc_id long, text string, spans string, n_email int")
    found = sorted((tuple(r) for r in pii.detect(df).select("doc_id", "n_email", "n_ip", "n_added", "spans").collect()), key=str)
    end = len(long)
    assert found == sorted([(1, 1, 0, 0, "email:0:6")] * 2 + [(None, 0, 1, 0, "ip:0:7"), (3, 0, 0, 0, ""), (4, 0, 0, 0, ""), (5, 1, 0, 1, f"email:{end - 23}:{end - 17},email:{end - 16}:{end}")], key=str)
    assert pii.detect(df.filter("false")).count() == 0
