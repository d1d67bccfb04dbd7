from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as spark_entry
from lexmill.plans.oracle import SQL
from lexmill.plans.queries import QUERIES


@pytest.fixture(scope="module")
def oracle(sf_dir):
    connection = duckdb.connect()
    for path in Path(sf_dir).glob("*.parquet"):
        connection.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return connection




def test_entry(spark):
    assert spark_entry.entry(spark).columns == ["word", "cnt"]


def test_every_sql_has_a_query():
    assert set(SQL) == set(QUERIES)
    assert set(QUERIES) <= set(spark_entry.queries()) and set(SQL) <= set(spark_entry.oracle_sql())


@pytest.mark.parametrize("name", list(SQL))
def test_query_equals_sql(spark, sf_dir, oracle, name):
    df = QUERIES[name](spark, sf_dir)
    columns = sorted(df.columns)
    found = [tuple(row) for row in df.select(columns).collect()]
    expected = oracle.execute(f"SELECT {', '.join(columns)} FROM ({SQL[name]})").fetchall()
    assert found
    assert sorted(found, key=repr) == sorted(expected, key=repr)
