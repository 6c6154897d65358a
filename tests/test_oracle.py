"""Every query with SQL gives the same rows as DuckDB on the provided tables."""

import os

import duckdb
import pytest

import __spark_entry__ as contract
from tests.helpers import as_counter

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()
# The queries on training data have tests of their own.
OTHERS = {"pipeline", *(contract.training_data.QUERIES if contract.training_data else ())}
QUERIES = {name: query for name, query in contract.queries().items() if name not in OTHERS}
SQL = {name: sql for name, sql in contract.oracle_sql().items() if name not in OTHERS}


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{FOLDER}/{name}.parquet'")
    return connection


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows(spark, duck, name):
    df = QUERIES[name](spark, FOLDER)
    expected = duck.execute(SQL[name])
    columns = [c[0] for c in expected.description]
    assert sorted(df.columns) == sorted(columns)
    assert as_counter(df.collect(), df.columns) == as_counter(expected.fetchall(), columns)


def test_every_sql_has_a_query():
    assert set(SQL) <= set(QUERIES)
    assert set(QUERIES) - set(SQL) == {
        "gbt_scores",
        "gain_importance",
        "permutation_importance",
        "contribution_importance",
        "visit_contributions",
        "model_metrics",
    }


def test_entry(spark):
    df = contract.entry(spark)
    assert df.columns == ["loyalty_tier", "visits", "conversions", "conversion_rate"]
    assert df.count() > 0
