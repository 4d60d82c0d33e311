"""Summaries of groups: medians, spreads, coverage, effective numbers."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.tables import stored
from .ranks import quantiles


def describe(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """n, mean, median, sd (0 for one row), exact 2.5 to 97.5 and 5 to 95 percentiles, least and greatest; null percentiles where a group has no value."""
    q = quantiles(df, value, {"median": 0.5, "q025": 0.025, "q05": 0.05, "q95": 0.95, "q975": 0.975}, by)
    m = df.groupBy(*by).agg(
        F.count(value).alias("n"), F.avg(value).alias("mean"), F.coalesce(F.stddev_samp(value), F.lit(0.0)).alias("sd"), F.min(value).alias("least"), F.max(value).alias("greatest")
    )
    return m.join(q, by, "left").select(*by, "n", "mean", "median", "sd", "q025", "q05", "q95", "q975", "least", "greatest")


def mad_scale(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """1.4826 times the median absolute deviation; 1 where that is below 1e-12."""
    df = stored(df.select(*by, value), "spread-rows")  # read four times, so what makes it runs once
    middle = stored(quantiles(df, value, {"median": 0.5}, by), "medians")
    away = df.join(middle, by).select(*by, F.abs(F.col(value) - F.col("median")).alias("away"))
    spread = quantiles(away, "away", {"away": 0.5}, by).select(*by, (F.col("away") * 1.4826).alias("s"))
    return middle.join(spread, by).select(*by, "median", F.when(F.col("s") < 1e-12, F.lit(1.0)).otherwise(F.col("s")).alias("scale"))


def coverage(cells: DataFrame, steps: list[int]) -> DataFrame:
    """(least, entities): entities with at least so many observed cells."""
    n = cells.groupBy("entity").agg(F.count("value").alias("n"))
    counts = n.agg(*[F.count_if(F.col("n") >= k).alias(str(k)) for k in steps])
    return counts.unpivot([], [str(k) for k in steps], "least", "entities").withColumn("least", F.col("least").cast("int"))


def largest_by(df: DataFrame, group: str, member: str, item: str) -> DataFrame:
    """For each group the member with most distinct items; of equals the least."""
    n = df.groupBy(group, member).agg(F.countDistinct(item).alias("items"))
    first = F.row_number().over(Window.partitionBy(group).orderBy(F.desc("items"), member))
    return n.withColumn("_n", first).where("_n = 1").drop("_n")


def first_last(df: DataFrame, by: list[str], value: str, order: str) -> DataFrame:
    """A group's first and last value by a declared order."""
    return df.groupBy(*by).agg(F.min_by(value, order).alias("first"), F.max_by(value, order).alias("last"))


def balanced_mean(df: DataFrame, unit: str, value: str) -> DataFrame:
    """The mean over units of each unit's mean, beside the mean of all rows."""
    each = df.groupBy(unit).agg(F.avg(value).alias("m"), F.sum(value).alias("s"), F.count(value).alias("n"))
    return each.agg(F.avg("m").alias("by_unit"), (F.sum("s") / F.sum("n")).alias("pooled"), F.count(F.lit(1)).alias("units"))


def effective_number(df: DataFrame, by: list[str], category: str) -> DataFrame:
    """exp of the entropy of a category's shares."""
    n = df.groupBy(*by, category).agg(F.count(F.lit(1)).alias("c"))
    total = n.groupBy(*by).agg(F.sum("c").alias("t"), F.sum(F.col("c") * F.log("c")).alias("cl"))
    return total.select(*by, F.exp(F.log("t") - F.col("cl") / F.col("t")).alias("effective"))


def weighted_correlation(df: DataFrame, x: str, y: str, w: str) -> DataFrame:
    """Weighted covariance (over 1 less the sum of squared shares) and correlation, about the weighted means of a first pass."""
    mean = df.agg(*[(F.sum(F.col(w) * F.col(v)) / F.sum(w)).alias(m) for m, v in (("mx", x), ("my", y))])
    from_mean = df.select(F.col(w).cast("double").alias("w"), F.col(x).alias("x"), F.col(y).alias("y")).join(F.broadcast(mean)).select("w", (F.col("x") - F.col("mx")).alias("a"), (F.col("y") - F.col("my")).alias("b"))
    c = lambda u, v: F.sum(F.col("w") * F.col(u) * F.col(v)) / F.sum("w")
    s = from_mean.agg(c("a", "b").alias("ab"), c("a", "a").alias("aa"), c("b", "b").alias("bb"), F.try_divide(F.sum(F.col("w") * F.col("w")), F.pow(F.sum("w"), F.lit(2))).alias("share"))
    return s.select((F.col("ab") / (1 - F.col("share"))).alias("cov"), F.try_divide(F.col("ab"), F.sqrt("aa") * F.sqrt("bb")).alias("r"))


def degree_bins(df: DataFrame, by: str, cap: int) -> DataFrame:
    """(degree, share): degrees of `by` values, those from `cap` on together."""
    d = df.groupBy(by).agg(F.least(F.count(F.lit(1)), F.lit(cap)).alias("degree")).groupBy("degree").agg(F.count(F.lit(1)).alias("c"))
    return d.join(d.agg(F.sum("c").alias("t"))).select("degree", F.col("c").alias("entities"), (F.col("c") / F.col("t")).alias("share"))


def collisions(edges: DataFrame, entity: str, item: str) -> DataFrame:
    """(degree, pairs, same): pairs of entities of one degree, and how many have the same items, by counting equal profiles."""
    profile = edges.groupBy(entity).agg(F.array_sort(F.collect_set(item)).alias("items"))
    n = profile.groupBy(F.size("items").alias("degree"), F.xxhash64("items").alias("h"), "items").agg(F.count(F.lit(1)).alias("c"))
    pairs = lambda c: c * (c - 1) / 2
    return n.groupBy("degree").agg(pairs(F.sum("c")).alias("pairs"), F.sum(pairs(F.col("c"))).alias("same"))


def balance(df: DataFrame, arm: str, value: str) -> DataFrame:
    """Standardised difference of means between arm 1 and arm 0, over the sd of all rows."""
    one, zero = F.avg(F.when(F.col(arm) == 1, F.col(value))), F.avg(F.when(F.col(arm) == 0, F.col(value)))
    return df.agg(((one - zero) / F.stddev_samp(value)).alias("difference"))
