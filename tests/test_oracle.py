"""Every registered query against its SQL on the smallest tables."""

import pytest

import __spark_entry__ as entry
from panelspark.plans.check import connect, differences

QUERIES, ORACLES = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def duck(sf):
    return connect(sf)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, sf, duck, name):
    assert differences(spark, name, QUERIES[name], ORACLES[name], sf, duck) == []


# Six hundred passes; its operator and its query of stumps are tested.
LONG = {"train_ensemble"}


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES) - LONG))
def test_query_without_sql_runs(spark, sf, name):
    df = QUERIES[name](spark, sf)
    assert df.count() >= 0 and len(set(df.columns)) == len(df.columns)


def test_entry(spark):
    assert entry.entry(spark).count() > 0
