"""Every registered query against its SQL on the smallest tables."""

import pytest

import __spark_entry__ as entry
from namesmith.plans import all_areas
from tests.compare import difference, duck

SF = "/root/testdata/sf0.001"
AREAS = all_areas()
QUERIES = {n: f for a in AREAS for n, f in a.queries.items()}
SQL = {n: q for a in AREAS for n, q in a.sql.items()}


@pytest.fixture(scope="module")
def con():
    return duck(SF)


def test_names():
    assert set(SQL) <= set(QUERIES)
    assert len(QUERIES) > 130


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_result(spark, con, name):
    assert difference(QUERIES[name](spark, SF), con, SQL[name]) is None


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_rows_only(spark, name):
    assert QUERIES[name](spark, SF).count() > 0


def test_entry(spark):
    df = entry.entry(spark)
    assert df.count() > 0 and len(df.columns) == len(set(df.columns))
