"""Every query of the library against its SQL on the smallest tables."""

import pytest
from oracle import SF, connect, same, there

from sitelens.plans.registry import ORACLES, QUERIES

pytestmark = pytest.mark.skipif(not there(), reason="no tables")


@pytest.fixture(scope="module")
def con():
    return connect()


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_oracle(spark, con, name):
    same(QUERIES[name](spark, SF), ORACLES[name], con)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_runs(spark, name):
    assert QUERIES[name](spark, SF).count() > 0


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(QUERIES) <= set(e.queries())
    assert set(e.oracle_sql()) <= set(e.queries())
