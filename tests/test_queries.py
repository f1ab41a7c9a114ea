"""Every query of the checks against its SQL on the smallest tables."""

import pytest

import __spark_entry__ as entry
from checks import all_queries
from compare import connect, rows

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(all_queries.QUERIES))
def test_query_equals_sql(spark, db, name):
    got = entry.queries()[name](spark, SF)
    mine = rows(got.toPandas())
    theirs = db.execute(entry.oracle_sql()[name]).fetchdf()
    assert sorted(got.columns) == sorted(theirs.columns)
    assert mine == rows(theirs)


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() > 0


def test_every_query_has_sql():
    assert set(all_queries.QUERIES) == set(all_queries.SQL)
