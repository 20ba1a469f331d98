"""Every registered query against its SQL, and the same rows however the input is partitioned."""

import oracle
import pytest

from blockwright import registry

QUERIES, SQL = registry.queries(), registry.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, name):
    got = oracle.rows(QUERIES[name](spark, oracle.DATA).toPandas())
    want = oracle.rows(oracle.connection().execute(SQL[name]).df())
    assert got == want


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_query_without_sql_runs(spark, name):
    assert QUERIES[name](spark, oracle.DATA).count() > 0


def test_every_sql_has_its_query():
    assert set(SQL) <= set(QUERIES)
