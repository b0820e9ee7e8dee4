"""Every query with an SQL twin gives the same rows as DuckDB."""

import sys
from pathlib import Path

import duckdb
import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
import __spark_entry__ as entry  # noqa: E402

DATA = "/root/testdata/sf0.001"
SQL = entry.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in Path(DATA).glob("*.parquet"):
        con.execute(f"create view {f.stem} as select * from '{f}'")
    return con


def ordered(rows):
    return sorted(rows, key=lambda r: [(v is None, str(v)) for v in r])


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, duck, name):
    df = entry.queries()[name](spark, DATA)
    columns = sorted(df.columns)
    cursor = duck.execute(SQL[name])
    found = [d[0] for d in cursor.description]
    assert columns == sorted(found)
    order = [found.index(c) for c in columns]
    want = ordered([r[i] for i in order] for r in cursor.fetchall())
    assert ordered([r[c] for c in columns] for r in df.collect()) == want


def test_every_oracle_has_a_query():
    assert set(SQL) <= set(entry.queries())
