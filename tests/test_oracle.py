"""Every named query against its SQL on the smallest given tables."""

import pytest

import __spark_entry__ as entry
from compare import SF, compare, connect
from suite.registry import ORACLES, QUERIES


@pytest.fixture(scope="module")
def db():
    return connect(SF)


def test_every_query_has_sql():
    assert set(ORACLES) == set(QUERIES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(spark, db, name):
    problems, _, _, _ = compare(spark, db, name, QUERIES[name], ORACLES[name], SF)
    assert not problems


def test_entry(spark):
    assert entry.entry(spark).count() > 0
