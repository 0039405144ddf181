"""Every registered query against its SQL, over the smallest data set."""
import duckdb
import pytest

from __spark_entry__ import entry, oracle_sql, queries
from check_queries import TABLES, compare


@pytest.fixture(scope="module")
def db(sf_dir):
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return connection


@pytest.mark.parametrize("name", list(queries()))
def test_query(spark, db, sf_dir, name):
    df = queries()[name](spark, sf_dir)
    got = [tuple(r) for r in df.collect()]
    assert got, "a query without rows proves nothing"
    sql = oracle_sql().get(name)
    if sql is not None:
        answer = db.execute(sql)
        assert compare(df.columns, got, [d[0] for d in answer.description], answer.fetchall()) is None


def test_every_sql_belongs_to_a_query():
    assert set(oracle_sql()) <= set(queries())


def test_entry(spark):
    assert entry(spark).limit(5).count() == 5
