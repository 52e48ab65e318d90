"""The queries that SQL can express, against that SQL."""

import pytest
from compare import connect, duck_rows, spark_rows

from tradewind.llm.oracles import ORACLES
from tradewind.llm.queries import QUERIES


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_its_sql(spark, sf_dir, name):
    columns, actual = spark_rows(QUERIES[name](spark, sf_dir))
    expected_columns, expected = duck_rows(connect(sf_dir), ORACLES[name])
    assert columns == expected_columns
    assert actual == expected
