"""Registered queries against DuckDB on the smallest tables."""

import pytest

import __spark_entry__  # registers all queries
from quillstack.plans import queries
from tests.conftest import SF, comparable


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_matches_sql(spark, duck, name):
    assert comparable(queries.QUERIES[name](spark, SF).toPandas()) == comparable(duck.execute(queries.SQL[name]).df())


def test_entry_points(spark):
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
    assert __spark_entry__.entry(spark).columns == ["question_id", "entry_id", "score", "matched", "rank"]
