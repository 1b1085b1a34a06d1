"""Every registered query against its SQL on the smallest tables."""

import pytest
from compare import compare, connect

from textward.plans.registry import REGISTRY

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", list(REGISTRY))
def test_query_matches_sql(spark, con, name):
    fn, sql = REGISTRY[name]
    message, ok = compare(spark, con, name, fn, sql, SF)
    assert ok, message
