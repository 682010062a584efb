"""Every registered query against its SQL, at the smallest scale."""

import os

import pytest

import __spark_entry__ as entry
from linkloom.plans import oracles
from linkloom.plans import queries as registered
from oracle import connect, difference

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def db():
    return connect(FOLDER)


def test_every_query_has_sql():
    assert registered.QUERIES.keys() == oracles.ORACLES.keys()
    assert registered.QUERIES.keys() <= entry.queries().keys()


@pytest.mark.parametrize("name", sorted(registered.QUERIES))
def test_query_equals_sql(spark, db, name):
    assert difference(entry.queries()[name](spark, FOLDER), db, entry.oracle_sql()[name]) is None


def test_flagship(spark):
    result = entry.entry(spark)
    assert result.columns == ["tag", "link", "popularity"] and not result.isEmpty()
