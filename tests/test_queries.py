import duckdb
import pytest

import __spark_entry__ as entry
from tools.check_queries import TABLES, normal

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    connection = duckdb.connect()
    for t in TABLES:
        connection.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    return connection


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_query_equals_sql(spark, db, name):
    got = normal(entry.queries()[name](spark, FOLDER).toPandas())
    want = normal(db.execute(entry.oracle_sql()[name]).df())
    assert got == want


def test_entry(spark):
    assert entry.entry(spark).count() > 0
