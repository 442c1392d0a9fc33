"""Every registered query against its SQL on the smallest tables."""

import os

import pytest

import __spark_entry__ as entry
from rollbook.plans import queries as catalogue
from tests.compare import connect, difference

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="test tables are not here")


@pytest.fixture(scope="module")
def db():
    return connect(FOLDER)


QUERIES, ORACLES = catalogue.load()


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLES)
    assert set(QUERIES) <= set(entry.queries()) and set(ORACLES) <= set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_agrees_with_sql(spark, db, name):
    df = entry.queries()[name](spark, FOLDER)
    assert difference(df.collect(), df.columns, db, entry.oracle_sql()[name]) is None


def test_entry(spark):
    assert not entry.entry(spark).isEmpty()
