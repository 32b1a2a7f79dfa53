import pytest
from compare import SF, connect, rows_of, rows_of_sql

from loomdex import catalogue


@pytest.fixture(scope="module")
def con():
    return connect()


@pytest.mark.parametrize("name", sorted(catalogue.SQL))
def test_query_matches_sql(spark, con, name):
    assert rows_of(catalogue.QUERIES[name](spark, SF)) == rows_of_sql(con, catalogue.SQL[name])


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.SQL)))
def test_query_without_sql_runs(spark, name):
    assert catalogue.QUERIES[name](spark, SF).count() > 0


def test_flagship(spark):
    df = catalogue.flagship(spark, SF)
    assert df.columns == ["doc_id", "term", "weight", "rank"] and df.count() > 0
