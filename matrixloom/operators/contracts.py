"""Checks that raise before rows are used: keys, joins, ranges, finiteness."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class ContractError(ValueError):
    """Rows break what the caller declared."""


def duplicates(df: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that occur more than once, with their counts."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def unique(df: DataFrame, keys: list[str]) -> DataFrame:
    """`df`, after a check that no key occurs twice."""
    if found := duplicates(df, keys).head(1):
        raise ContractError(f"key {keys} occurs twice: {found[0].asDict()}")
    return df


def validated_join(left: DataFrame, right: DataFrame, on: list[str], how: str = "inner", validate: str = "one_to_one") -> DataFrame:
    """A join after checks of its cardinality: one_to_one, one_to_many or many_to_one."""
    one_left, _, one_right = validate.partition("_to_")
    if one_left == "one":
        unique(left, on)
    if one_right == "one":
        unique(right, on)
    return left.join(right, on, how)


def finite(df: DataFrame, columns: list[str]) -> DataFrame:
    """`df`, after a check that columns hold no null, NaN or infinite value."""
    bad = [F.count_if(F.col(c).isNull() | F.isnan(c) | (F.abs(c) == float("inf"))).alias(c) for c in columns]
    counts = df.agg(*bad).first().asDict()
    if any(counts.values()):
        raise ContractError(f"values that are not finite: {counts}")
    return df


def within(df: DataFrame, column: str, low: float, high: float) -> DataFrame:
    """`df`, after a check that a column lies in [low, high]."""
    if df.where(~F.col(column).between(low, high)).head(1):
        raise ContractError(f"{column} leaves [{low}, {high}]")
    return df


def shape(df: DataFrame, rows: int, columns: int) -> DataFrame:
    """`df`, after a check of its numbers of rows and columns."""
    if (n := df.count(), len(df.columns)) != (rows, columns):
        raise ContractError(f"{n} rows of {len(df.columns)} columns, not {rows} of {columns}")
    return df
