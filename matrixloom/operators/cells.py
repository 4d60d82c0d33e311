"""Cell tables (entity, feature, value): making, filtering, filling and reshaping score matrices."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ranks import quantiles

KEYS = ["entity", "feature"]


def number(column: Column) -> Column:
    """Text as a double; what isn't a number, and NaN, become null."""
    x = column.try_cast("double")
    return F.when(~F.isnan(x), x)


def vector_cells(df: DataFrame, entity: str, vector: str) -> DataFrame:
    """One cell for each place of an array column; features are places from 0."""
    return df.select(F.col(entity).alias("entity"), F.posexplode(vector).alias("feature", "value")).withColumn("value", number(F.col("value")))


def wide_cells(df: DataFrame, entity: str, features: list[str]) -> DataFrame:
    """A wide table's columns as cells."""
    return df.unpivot([entity], features, "feature", "value").withColumnRenamed(entity, "entity").withColumn("value", number(F.col("value")))


def wide(cells: DataFrame, features: list, prefix: str = "") -> DataFrame:
    """One row for each entity, one column for each declared feature in order; absent cells are null.

    Each cell occurs once (see contracts.unique). The feature list is declared, so no pass finds it.
    """
    return cells.groupBy("entity").agg(*[F.max(F.when(F.col("feature") == f, F.col("value"))).alias(f"{prefix}{f}") for f in features])


def clip_above(value: Column, top: float = 0.0) -> Column:
    """At most `top`; null stays null."""
    return F.when(value > top, F.lit(top)).otherwise(value)


def complete_cases(cells: DataFrame, features: int) -> DataFrame:
    """Cells of entities that have all features observed."""
    full = cells.groupBy("entity").agg(F.count("value").alias("n")).where(F.col("n") == features).select("entity")
    return cells.join(full, "entity", "left_semi")


def fill(cells: DataFrame, how: str) -> DataFrame:
    """Missing cells get their feature's `mean` or exact `median`, joined from one row a feature."""
    fillers = {"mean": lambda: cells.groupBy("feature").agg(F.avg("value").alias("filler")), "median": lambda: quantiles(cells, "value", {"filler": 0.5}, ["feature"])}
    return cells.join(fillers[how](), "feature", "left").select("entity", "feature", F.coalesce("value", "filler").alias("value"))


def grid(cells: DataFrame) -> DataFrame:
    """Every entity with every feature that occurs, absent cells null. Features, the short side, are joined to all entities."""
    entities, features = cells.select("entity").distinct(), cells.select("feature").distinct()
    return entities.join(features).join(cells, KEYS, "left")


def drop_sparsest(cells: DataFrame) -> DataFrame:
    """All features but the one with most missing cells; of equals the first by name goes."""
    missing = cells.groupBy("feature").agg(F.count_if(F.col("value").isNull()).alias("missing"))
    worst = missing.orderBy(F.desc("missing"), "feature").limit(1).select("feature")
    return cells.join(worst, "feature", "left_anti")


def additive_fill(cells: DataFrame, rounds: int = 500, within: float = 1e-10) -> DataFrame:
    """Missing cells as row plus column effect fitted by least squares on observed cells.

    Row and column means are taken in turn until no column effect moves by more than `within`; each round is two aggregations, cut by a
    checkpoint every ten, where the last change is looked at. Raises if `rounds` aren't enough, or if an entity or a feature has no observed cell.
    """
    blank = [cells.groupBy(c).agg(F.count("value").alias("n")).where("n = 0").isEmpty() for c in ("entity", "feature")]
    if not all(blank):
        raise ValueError("an entity or a feature has no observed cell")
    seen = cells.where(F.col("value").isNotNull())
    rows = seen.groupBy("entity").agg(F.avg("value").alias("r"))
    old, moved = None, math.inf
    for i in range(rounds):
        cols = seen.join(rows, "entity").groupBy("feature").agg(F.avg(F.col("value") - F.col("r")).alias("c"))
        rows = seen.join(cols, "feature").groupBy("entity").agg(F.avg(F.col("value") - F.col("c")).alias("r"))
        if i % 10 == 8:
            cols = old = cols.checkpoint()
            rows = seen.join(cols, "feature").groupBy("entity").agg(F.avg(F.col("value") - F.col("c")).alias("r"))
        if i % 10 == 9:
            rows, cols = rows.checkpoint(), cols.checkpoint()
            moved = cols.join(old.withColumnRenamed("c", "o"), "feature").agg(F.max(F.abs(F.col("c") - F.col("o")))).first()[0] or 0.0
            if moved <= within:
                break
    if moved > within:
        raise ValueError(f"no convergence in {rounds} rounds: effects still move by {moved}")
    return cells.join(rows, "entity", "left").join(cols, "feature", "left").select("entity", "feature", F.coalesce("value", F.col("r") + F.col("c")).alias("value"))


def successive(frames: list[DataFrame], key: str) -> DataFrame:
    """Inner joins of several frames on one key, in order."""
    return reduce(lambda a, b: a.join(b, key), frames)


def blocks(cells: DataFrame, size: int, values: list[str]) -> DataFrame:
    """(block, x): for each entity every set of `size` of its features, sorted, with their values as an array of structs.

    An entity's own features are chained to sets in its row, so nothing is joined; its number of features bounds what a row gives.
    """
    held = cells.groupBy("entity").agg(F.array_sort(F.collect_list(F.struct("feature", *values))).alias("all"))
    x = held.select("all", F.array().cast("array<int>").alias("at"), F.lit(1).alias("_from"))
    for left in reversed(range(size)):
        places = F.sequence(F.col("_from"), F.size("all") - left)
        x = x.where(F.col("_from") <= F.size("all") - left).select("all", "at", F.explode(places).alias("_next"))
        x = x.select("all", F.array_append("at", F.col("_next")).alias("at"), (F.col("_next") + 1).alias("_from"))
    chosen = x.select(F.transform("at", lambda k: F.element_at("all", k)).alias("x"))
    return chosen.select(F.array_join("x.feature", " ").alias("block"), "x")
