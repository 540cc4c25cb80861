"""Every registered query with a check agrees with DuckDB on the smallest tables."""

import pytest

import __spark_entry__ as driver
from compare import differences, duck

SF = "/root/testdata/sf0.001"
QUERIES, CHECKS = driver.queries(), driver.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", [n for n in QUERIES if n in CHECKS])
def test_agrees(spark, con, name):
    assert differences(QUERIES[name](spark, SF), con, CHECKS[name]) == []


@pytest.mark.parametrize("name", [n for n in QUERIES if n not in CHECKS])
def test_runs(spark, name):
    assert QUERIES[name](spark, SF).count() > 0


def test_checks_belong_to_queries():
    assert set(CHECKS) <= set(QUERIES)


def test_entry(spark):
    row = driver.entry(spark).collect()[0]
    assert row["status"] == "FAIL" and row["missing_in_target"] > 0
