"""Road queries equal their SQL on tables of other shapes than the given ones: means on rounding ties, columns that are not correlated."""

from datetime import datetime, timedelta

import duckdb
import pytest

from roadspeed import queries as road

START = datetime(2024, 1, 1)


def write(spark, path, rows):
    table = [(i, START + timedelta(hours=h), u, "view", v, "{}") for i, (h, u, v) in enumerate(rows)]
    spark.createDataFrame(table, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string").coalesce(1).write.parquet(f"{path}/events.parquet")
    return path


def same(spark, path, name):
    found = road.QUERIES[name](spark, path)
    names = sorted(found.columns)
    with duckdb.connect() as con:
        con.sql(f"CREATE VIEW events AS SELECT * FROM '{path}/events.parquet/*.parquet'")
        expected = con.sql(road.ORACLE_SQL[name]).project(", ".join(f'"{n}"' for n in names)).fetchall()
    plain = lambda rows: sorted((tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in rows), key=str)
    assert plain(found.select(*names).collect()) == plain(expected)
    return len(expected)


@pytest.fixture(scope="module")
def ties(spark, tmp_path_factory):
    """Sixteen readings an hour of 42.69125 or 69.92875 in the mean, doubles on a tie of the fourth decimal: 42.6912 and 69.9287 by the SQL."""
    mean = lambda h, u: (68306, 111886, 70000)[(h + u) % 3]
    rows = [(h, u, (mean(h, u) // 16 + (i < mean(h, u) % 16)) / 100) for h in range(60) for u in range(8) for i in range(16)]
    return write(spark, str(tmp_path_factory.mktemp("ties")), rows)


@pytest.mark.parametrize("name", ["read_readings", "seq_windows", "seq2seq_windows", "seq_windows_chunked", "seq2seq_windows_chunked", "to_wide_arrays", "to_wide_dense"])
def test_means_on_ties(spark, ties, name):
    assert same(spark, ties, name)


@pytest.mark.parametrize(("value", "n"), [(lambda h: 50.0 + h * 7 % 5 / 10, 0), (lambda h: 50.0 + h % 24, 0), (lambda h: 50.0 + h * 37 % 101, 120)])
def test_selection_differs(spark, tmp_path, value, n):
    assert same(spark, write(spark, str(tmp_path), [(h, 0, value(h)) for h in range(120)]), "keep_correlated") == n
