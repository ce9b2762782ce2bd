"""Every road query that SQL can express gives the rows of its SQL over the smallest tables."""

import duckdb
import pytest

from roadspeed import queries as road

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def tables():
    con = duckdb.connect()
    for name in ("events", "lineitem"):
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    yield con
    con.close()


def plain(rows):
    return sorted((tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in rows), key=str)


@pytest.mark.parametrize("name", sorted(road.ORACLE_SQL))
def test_same_rows(spark, tables, name):
    found, expected = road.QUERIES[name](spark, SF), tables.sql(road.ORACLE_SQL[name])
    names = sorted(found.columns)
    assert names == sorted(expected.columns)
    assert plain(found.select(*names).collect()) == plain(expected.project(", ".join(f'"{n}"' for n in names)).fetchall())
