import pytest
from parity import both

from memlattice.registry import ORACLES, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_its_sql(spark, name):
    got, expected = both(spark, QUERIES[name], ORACLES[name])
    assert got == expected


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_query_without_sql_runs(spark, name):
    assert QUERIES[name](spark, "/root/testdata/sf0.001").count() >= 0
