"""Each query of the library beside its DuckDB form; those without one run and keep their columns."""

from __future__ import annotations

import pytest

from rosterlake.plans import catalog
from tests.oracle import compare, connection

QUERIES, ORACLES = catalog.queries(), catalog.oracle_sql()


@pytest.fixture(scope="module")
def con(sf):
    return connection(sf)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_equals_oracle(spark, sf, con, name):
    assert compare(QUERIES[name](spark, sf), con, ORACLES[name]) == ""


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_runs(spark, sf, name):
    df = QUERIES[name](spark, sf)
    assert df.columns and df.count() >= 0
