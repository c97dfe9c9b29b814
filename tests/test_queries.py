import pytest

import __spark_entry__ as entry
from readsieve.plans import oracle, queries

from .oracles import SMALL, assert_same, connection


@pytest.fixture(scope="module")
def con():
    return connection()


@pytest.mark.parametrize("name", sorted(queries.queries()))
def test_query_equals_sql(spark, con, name):
    assert assert_same(queries.queries()[name](spark, SMALL), oracle.oracle_sql()[name], con) > 0


def test_entry(spark):
    assert entry.entry(spark).count() == 200
    assert set(queries.queries()) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())
