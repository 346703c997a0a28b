"""Every registered query against DuckDB on the smallest tables."""

from __future__ import annotations

import pytest

import __spark_entry__ as driver
from oracle import duck, rows_of, rows_of_sql
from tallyfold.plans import registry

FOLDER = driver.SMOKE
QUERIES = {n: run for n, run in driver.queries().items() if n in registry.QUERIES}
ORACLES = registry.ORACLES


@pytest.fixture(scope="module")
def con():
    return duck(FOLDER)


def test_every_oracle_has_its_query():
    assert set(ORACLES) <= set(QUERIES)


def test_entry(spark):
    assert driver.entry(spark).count() > 0


@pytest.mark.parametrize("name", QUERIES)
def test_query(spark, con, name):
    found = rows_of(QUERIES[name](spark, FOLDER))
    assert found == rows_of_sql(con, ORACLES[name])
