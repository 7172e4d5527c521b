"""Every registered query against its SQL twin on the smallest tables.

No query has to yield rows here: the smallest tables hold, for one, no supplier in debt and so no
orphan. At sf 0.01 every query does (``TEST_SF_DIR`` selects the tables).
"""

import os

import duckdb
import pytest

from __spark_entry__ import entry, oracle_sql, queries

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for table in TABLES:
        con.sql(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    return con


def _cell(value):
    return repr(round(value, 9) + 0.0) if isinstance(value, float) else str(value)


def _rows(rows):
    return sorted(tuple(map(_cell, row)) for row in rows)


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_query_matches_sql(spark, duck, name):
    frame = queries()[name](spark, SF)
    columns = sorted(frame.columns)
    got = _rows(frame.select(*columns).collect())
    expected = duck.sql(oracle_sql()[name])
    assert sorted(expected.columns) == columns
    listed = ", ".join(f'"{c}"' for c in columns)
    assert got == _rows(duck.sql(f"SELECT {listed} FROM ({oracle_sql()[name]}) q").fetchall())


def test_entry(spark):
    rows = entry(spark).collect()
    assert [row["data_integrity"] for row in rows] == [1.0]
