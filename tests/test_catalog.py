"""Every registered query against DuckDB on the driver's smallest tables."""

from __future__ import annotations

import os

import compare
import pytest

import __spark_entry__ as driver

FOLDER = os.environ.get("GASFLOW_TEST_FOLDER", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def duck():
    return compare.connect(FOLDER)


def check(spark, duck, name):
    df = driver.queries()[name](spark, FOLDER)
    assert compare.differences(df.collect(), df.columns, duck, driver.oracle_sql()[name]) == []


@pytest.mark.parametrize("name", sorted(driver.oracle_sql()))
def test_same_as_sql(spark, duck, name):
    check(spark, duck, name)


@pytest.mark.parametrize("name", sorted(set(driver.queries()) - set(driver.oracle_sql())))
def test_without_sql_gives_rows(spark, name):
    assert driver.queries()[name](spark, FOLDER).count() > 0


def test_sql_only_for_queries():
    assert set(driver.oracle_sql()) <= set(driver.queries())


def test_entry(spark):
    assert driver.entry(spark).count() > 0
