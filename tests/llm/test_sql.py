"""Queries that SQL can express, held against it over whole small tables."""

import pytest

from matrixloom.llm.queries import ORACLES, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_its_sql(spark, small, same_as_sql, name):
    same_as_sql(QUERIES[name](spark, small), ORACLES[name])
