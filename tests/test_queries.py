"""Every registered query runs, and has the columns of its SQL."""

import duckdb
import pytest

import __spark_entry__ as entry
from catalog_queries import detail_queries, function_queries, listing_queries, run_queries

SF = "/root/testdata/sf0.001"
TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark "
          "labels conversations").split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{SF}/{name}.parquet')")
    return con


CATALOGUE = [name for module in (listing_queries, detail_queries, function_queries, run_queries) for name in module.QUERIES]


def test_every_catalogue_query_has_sql():
    assert set(CATALOGUE) <= set(entry.oracle_sql())


@pytest.mark.parametrize("name", CATALOGUE)
def test_query_matches_sql(spark, duck, name):
    from catalog_queries.check import rows_of
    df = entry.queries()[name](spark, SF)
    answer = duck.execute(entry.oracle_sql()[name])
    columns = [d[0] for d in answer.description]
    assert sorted(columns) == sorted(df.columns)
    assert rows_of(df.columns, df.collect()) == rows_of(columns, answer.fetchall())


def test_entry(spark):
    df = entry.entry(spark)
    assert df.count() > 0 and "brand" in df.columns
