"""Every registered query against its SQL on the smallest tables."""

import pytest

import __spark_entry__ as driver
from check import compare, duck

FOLDER = driver.SMOKE_DIR


@pytest.fixture(scope="module")
def con():
    return duck(FOLDER)


def test_registry():
    assert set(driver.oracle_sql()) <= set(driver.queries())


def test_entry(spark):
    assert driver.entry(spark).count() == 13


@pytest.mark.parametrize("name", sorted(driver.queries()))
def test_query(spark, con, name):
    result = compare(spark, con, FOLDER, name, driver.oracle_sql().get(name))
    assert result.startswith(("ok", "rows")), result
