"""Every registered query against its SQL, and the contract of the entry file."""

import pytest
from compare import connect, duck_rows, spark_rows

import __spark_entry__ as contract
from tradewind.oracles import ORACLES
from tradewind.queries import QUERIES


@pytest.fixture(scope="module")
def duck(sf_dir):
    return connect(sf_dir)


def test_every_query_has_an_oracle():
    assert QUERIES.keys() == ORACLES.keys()
    assert QUERIES.keys() <= contract.queries().keys()
    assert ORACLES.keys() <= contract.oracle_sql().keys()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_its_sql(spark, sf_dir, duck, name):
    columns, actual = spark_rows(contract.queries()[name](spark, sf_dir))
    expected_columns, expected = duck_rows(duck, contract.oracle_sql()[name])
    assert columns == expected_columns
    assert len(actual) == len(expected)
    assert actual == expected


def test_entry_has_rows(spark):
    assert contract.entry(spark).count() > 0
