"""Every registered query against its SQL on the smallest test tables."""

import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry
from catalog.registry import QUERIES
from scripts.check import rows_of

SF = "/root/testdata/sf0.001"

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are not there")


@pytest.fixture(scope="module")
def sql():
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for path in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def test_registration():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert len(entry.queries()) > 120


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["conv_id", "system", "prompt", "chosen", "rejected"] and df.count() > 0


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sql, name):
    df = QUERIES[name](spark, SF)
    got = rows_of(df.columns, df.collect())
    if name in entry.oracle_sql():
        result = sql.execute(entry.oracle_sql()[name])
        names = [c[0] for c in result.description]
        assert sorted(names) == sorted(df.columns)
        assert got == rows_of(names, result.fetchall())
