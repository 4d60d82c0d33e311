"""Every registered query of the engine against its SQL over whole tables."""

import pytest

import __spark_entry__
from matrixloom.plans.registry import ORACLES, QUERIES

DATA = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_its_sql(spark, same_as_sql, name):
    same_as_sql(QUERIES[name](spark, DATA), ORACLES[name], DATA)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_query_without_sql_returns_rows(spark, name):
    assert not QUERIES[name](spark, DATA).isEmpty()


def test_entry_and_contract(spark):
    rows = {r["surface"]: r["pr"] for r in __spark_entry__.entry(spark).collect()}
    assert rows["row_centred"] == pytest.approx(rows["two_way"], abs=1e-5) and rows["raw"] > rows["two_way"]
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
