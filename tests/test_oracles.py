"""Every registered query against its DuckDB oracle."""

import pytest

import __spark_entry__ as driver
from oracle import connect, difference
from precolens.plans.oracles import ORACLES
from precolens.plans.queries import QUERIES


@pytest.fixture(scope="module")
def duck(folder):
    return connect(folder)


def test_every_query_has_an_oracle():
    assert set(QUERIES) == set(ORACLES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(name, spark, folder, duck):
    assert difference(driver.queries()[name](spark, folder), duck, driver.oracle_sql()[name]) is None


def test_flagship_has_rows(spark):
    page = driver.entry(spark)
    assert 0 < page.count() <= 30
