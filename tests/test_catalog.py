"""Every registered query of the core: against its SQL, or for rows."""

from __future__ import annotations

import pytest

from copse.plans import catalog, derived  # noqa: F401
from tests.oracle import assert_same, connection


@pytest.fixture(scope="module")
def con(small):
    return connection(small)


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_matches_sql(spark, small, con, name):
    assert_same(catalog.QUERIES[name](spark, small), catalog.ORACLES[name], con)


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLES)))
def test_has_rows(spark, small, name):
    df = catalog.QUERIES[name](spark, small)
    assert df.count() > 0
    assert df.schema == catalog.QUERIES[name](spark, small).schema


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() == 4
    assert set(e.oracle_sql()) <= set(e.queries())
