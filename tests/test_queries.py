"""Every registered query agrees with its SQL on the smallest sample."""

import pytest

import __spark_entry__ as contract
from check_oracle import compare, connect


@pytest.fixture(scope="module")
def database(sample):
    return connect(sample)


@pytest.mark.parametrize("name", sorted(contract.queries()))
def test_query_matches_sql(spark, database, sample, name):
    _, verdict = compare(spark, database, sample, name)
    assert verdict in ("ok", "no SQL"), verdict


def test_contract(spark):
    assert contract.entry(spark).count() == 5
    assert set(contract.oracle_sql()) <= set(contract.queries())
