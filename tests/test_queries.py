"""Every core query over the smallest tables, against its SQL where it has one."""

import pytest

from wordloom.plans import registry

from .oracle import compare, tables

D = "/root/testdata/sf0.001"
QUERIES, SQL = registry.gather("QUERIES"), registry.gather("SQL")


@pytest.fixture(scope="module")
def con():
    return tables(D)


def test_sql_has_a_query():
    assert set(SQL) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(SQL))
def test_against_sql(spark, con, name):
    compare(spark, con, D, QUERIES[name], SQL[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(spark, name):
    assert QUERIES[name](spark, D).count() > 0
