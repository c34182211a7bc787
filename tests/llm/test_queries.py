"""Each query over its whole table; by SQL where there is some."""

import pytest

from tests.comparing import connection, duck_rows, spark_rows
from tidemark.llm import queries


@pytest.mark.parametrize("name", list(queries.queries()))
def test_query(name, spark, sf_dir):
    names, rows = spark_rows(queries.queries()[name](spark, sf_dir))
    assert rows
    if name in queries.oracle_sql():
        assert (names, rows) == duck_rows(connection(sf_dir), queries.oracle_sql()[name])
