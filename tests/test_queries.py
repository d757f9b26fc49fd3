import duckdb
import pytest

import __spark_entry__ as contract
from bindery.plans import catalog, oracle
from check import TABLES, rows_of
from tests.conftest import SMALL

TWINS = contract.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for table in TABLES:
        connection.execute(f"create view {table} as select * from '{SMALL}/{table}.parquet'")
    return connection


def test_every_query_has_a_twin():
    """Those of the optional operators without one are compared with brute force in their own tests."""
    assert set(oracle.statements()) == set(catalog.QUERIES)
    assert set(TWINS) <= set(contract.queries())


@pytest.mark.parametrize("name", list(catalog.QUERIES))
def test_query_equals_its_twin(spark, duck, name):
    df = contract.queries()[name](spark, SMALL)
    answer = duck.execute(TWINS[name])
    columns = [c[0] for c in answer.description]
    assert sorted(df.columns) == sorted(columns)
    assert rows_of(df.columns, df.collect()) == rows_of(columns, answer.fetchall())


def test_entry(spark):
    assert contract.entry(spark).count() > 0
