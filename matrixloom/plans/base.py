"""The matrices that queries run on, made from the driver's tables, and the same as SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import cells as C
from ..sources.tables import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

#: Places of an embedding, and brands of parts: the declared features of the two matrices.
DENSE = list(range(64))
BRANDS = sorted(f"Brand#{i}" for i in range(1, 26))


def query(name: str, sql: str | None = None):
    """Registers a query under a name, with SQL that says what it returns."""

    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


def dense(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells of the embeddings: entity, feature (0 to 63), value."""
    return C.vector_cells(table(spark, sf_dir, "embeddings"), "vec_id", "embedding")


def dense_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same matrix as `dense`, one row for each embedding: entity, x."""
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("entity"), F.col("embedding").cast("array<double>").alias("x"))


def priced(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells of suppliers by brands: value and measured (log of the mean price), score (mean discount)."""
    lines = table(spark, sf_dir, "lineitem").select("l_suppkey", "l_partkey", "l_extendedprice", "l_discount")
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_brand")
    g = lines.join(parts, F.col("l_partkey") == F.col("p_partkey")).groupBy(F.col("l_suppkey").alias("entity"), F.col("p_brand").alias("feature"))
    value = F.round(F.log(F.avg("l_extendedprice")), 9)
    return g.agg(value.alias("value"), value.alias("measured"), F.round(F.avg("l_discount"), 8).alias("score"))


def sparse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells of suppliers by brands over large lines only: many cells are missing."""
    lines = table(spark, sf_dir, "lineitem").where("l_quantity > 48").select("l_suppkey", "l_partkey", "l_extendedprice")
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_brand")
    g = lines.join(parts, F.col("l_partkey") == F.col("p_partkey")).groupBy(F.col("l_suppkey").alias("entity"), F.col("p_brand").alias("feature"))
    return g.agg(F.round(F.log(F.avg("l_extendedprice")), 9).alias("value"))


def groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(entity, grp): the nation of each supplier."""
    return table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("entity"), F.col("s_nationkey").alias("grp"))


_JOINED = "lineitem JOIN part ON l_partkey = p_partkey"
DENSE_SQL = "dense AS (SELECT vec_id AS entity, t AS feature, x::DOUBLE AS value FROM (SELECT vec_id, unnest(embedding) AS x, (generate_subscripts(embedding, 1) - 1)::INTEGER AS t FROM embeddings))"
PRICED_SQL = f"priced AS (SELECT l_suppkey AS entity, p_brand AS feature, round(ln(avg(l_extendedprice)), 9) AS value, round(ln(avg(l_extendedprice)), 9) AS measured, round(avg(l_discount), 8) AS score FROM {_JOINED} GROUP BY 1, 2)"
SPARSE_SQL = f"sparse AS (SELECT l_suppkey AS entity, p_brand AS feature, round(ln(avg(l_extendedprice)), 9) AS value FROM {_JOINED} WHERE l_quantity > 48 GROUP BY 1, 2)"
GROUPS_SQL = "grp AS (SELECT s_suppkey AS entity, s_nationkey AS grp FROM supplier)"
#: Average rank of {v} within {by}.
RANK_SQL = "(rank() OVER (PARTITION BY {by} ORDER BY {v}) + (count(*) OVER (PARTITION BY {by}, {v}) - 1) / 2.0)"


def uniform_sql(*key: str) -> str:
    """The number in (0, 1) that `uniform` gives for the same key."""
    return f"(('0x' || substr(sha256({" || '|' || ".join(key)}), 1, 13))::BIGINT + 0.5) / 4503599627370496"


def rank_sql(by: str, v: str) -> str:
    return RANK_SQL.format(by=by, v=v)
