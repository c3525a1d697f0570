"""Every registered query against its SQL on the smallest tables."""

import os

import pytest

from gatecount.plans import registry
from tests.oracle import compare, connect

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query_matches_sql(spark, con, name):
    query, sql = registry.queries()[name], registry.oracles().get(name)
    if sql is None:
        assert query(spark, SF).count() >= 0
        return
    ok, note = compare(spark, con, SF, query, sql)
    assert ok, note


def test_every_oracle_has_a_query():
    assert registry.oracles().keys() <= registry.queries().keys()
