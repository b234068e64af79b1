"""Every registered query against its DuckDB twin on the smallest tables."""

import os

import pytest
from compare import difference, duck

import __spark_entry__ as entry
from marginwise import catalog

SMALL = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SMALL), reason="no test tables")


@pytest.fixture(scope="module")
def con():
    return duck(SMALL)


def test_every_query_has_a_twin():
    assert catalog.QUERIES.keys() == catalog.ORACLES.keys()
    assert catalog.QUERIES.keys() <= entry.queries().keys()


@pytest.mark.parametrize("name", catalog.QUERIES)
def test_query(spark, con, name):
    assert difference(spark, con, catalog.QUERIES[name], catalog.ORACLES[name], SMALL) is None


def test_flagship(spark):
    row = entry.entry(spark).first()
    assert row["n"] == 50 and row["correct"] > 25
