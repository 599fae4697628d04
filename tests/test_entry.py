"""Every query against its SQL on the smallest tables."""

import glob
import os

import duckdb
import pytest

import __spark_entry__
from catalogue.oracles import ORACLES
from catalogue.queries import QUERIES
from check_queries import rows_of

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def database():
    connection = duckdb.connect()
    for path in glob.glob(f"{SMALL}/*.parquet"):
        name = os.path.basename(path)[: -len(".parquet")]
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return connection


def test_entry(spark):
    frame = __spark_entry__.entry(spark)
    assert frame.count() > 0 and "vendor" in frame.columns


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, database, name):
    frame = __spark_entry__.queries()[name](spark, SMALL)
    result = database.execute(__spark_entry__.oracle_sql()[name])
    columns = [d[0] for d in result.description]
    assert sorted(frame.columns) == sorted(columns)
    assert rows_of(frame.columns, frame.collect()) == rows_of(columns, result.fetchall())
