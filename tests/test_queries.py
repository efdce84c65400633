"""Every query with SQL gives the rows that DuckDB gives; the others run."""

import pytest

from tests.compare import connect, of_duckdb, of_spark
from trialweave.plans import registry

SQL = registry.oracle_sql()
QUERIES = registry.queries()


@pytest.fixture(scope="module")
def con(sf):
    return connect(sf)


@pytest.mark.parametrize("name", sorted(SQL))
def test_equals_sql(spark, sf, con, name):
    assert of_spark(QUERIES[name](spark, sf)) == of_duckdb(con, SQL[name])


@pytest.mark.parametrize("name", ["RSD02", "DYN01", "DYN12", "JOIN10", "JOIN12", "ML07", "ML13", "ML17", "RES02", "RES06"])
def test_runs_twice_alike(spark, sf, name):
    first = of_spark(QUERIES[name](spark, sf))
    assert first == of_spark(QUERIES[name](spark, sf))
    assert first[1]


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
