"""Every query equals its DuckDB statement, in rows, names and types."""

import __spark_entry__ as entry
import pytest
from compare import duck, duck_rows, duck_types, spark_rows, spark_types

from oracles.statements import oracle_statements
from tenure.catalog import all_queries

QUERIES = all_queries()
STATEMENTS = oracle_statements()


@pytest.fixture(scope="module")
def con(sf_dir):
    return duck(sf_dir)


def test_every_query_has_a_statement():
    assert set(QUERIES) == set(STATEMENTS)
    assert set(QUERIES) <= set(entry.queries())
    assert set(STATEMENTS) <= set(entry.oracle_sql())


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_statement(spark, con, sf_dir, name):
    df = QUERIES[name](spark, sf_dir)
    assert spark_types(df) == duck_types(con, STATEMENTS[name])
    assert spark_rows(df) == duck_rows(con, STATEMENTS[name])


def test_entry(spark):
    df = entry.entry(spark)
    assert df.count() == 150
    assert {"user_id", "has_access", "access_type"} <= set(df.columns)
