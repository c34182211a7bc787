"""Each query against the SQL that stands beside it."""

import pytest

from tests.comparing import connection, duck_rows, spark_rows
from tidemark.plans import catalogue

EMPTY = {"sightings_species_empty"}


@pytest.fixture(scope="module")
def con(sf_dir):
    return connection(sf_dir)


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(name, spark, sf_dir, con):
    names, rows = spark_rows(catalogue.QUERIES[name](spark, sf_dir))
    assert bool(rows) != (name in EMPTY)
    if name in catalogue.ORACLES:
        assert (names, rows) == duck_rows(con, catalogue.ORACLES[name])


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
