"""Every registered query against its SQL twin on the smallest tables."""

import pytest

import __spark_entry__ as registry
from compare import compare, duck
from jobfacts.plans import catalog, oracle


@pytest.fixture(scope="module")
def con(sf):
    return duck(sf)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query_equals_sql(spark, sf, con, name):
    assert compare(spark, con, name, sf) is None


def test_every_query_has_a_twin():
    assert set(catalog.QUERIES) == set(oracle.ORACLE)
    assert set(oracle.ORACLE) <= set(registry.oracle_sql()) <= set(registry.queries())


def test_entry(spark):
    rows = registry.entry(spark).collect()
    assert len(rows) == 5 and all(r.total_jobs > 0 for r in rows)
