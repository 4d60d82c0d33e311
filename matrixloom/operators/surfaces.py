"""Surfaces of a score matrix: centring, scaling, variance shares, fits on reference entities."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .ranks import average_rank, normal_quantile


def _means(cells: DataFrame, weight: str | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Entity, feature and grand means. Weights, if any, count for features and the grand mean."""
    mean = F.avg("value") if weight is None else F.sum(F.col("value") * F.col(weight)) / F.sum(F.when(F.col("value").isNotNull(), F.col(weight)))
    rows = cells.groupBy("entity").agg(F.avg("value").alias("row_mean"))
    cols = cells.groupBy("feature").agg(mean.alias("col_mean"))
    return rows, cols, cells.agg(mean.alias("grand"))


def centred(cells: DataFrame, rows: bool = True, columns: bool = True, weight: str | None = None) -> DataFrame:
    """Cells less their entity's mean, their feature's mean, or both and then plus the grand mean.

    Means are aggregations joined back: the feature means are few, so that side is small.
    """
    by_row, by_col, grand = _means(cells, weight)
    out, value = cells, F.col("value")
    if rows:
        out, value = out.join(by_row, "entity"), value - F.col("row_mean")
    if columns:
        out, value = out.join(by_col, "feature"), value - F.col("col_mean")
    if rows and columns:
        out, value = out.join(grand), value + F.col("grand")
    return out.select("entity", "feature", *([weight] if weight else []), value.alias("value"))


def scaled(cells: DataFrame, population: bool = False, least: float = 1e-12) -> DataFrame:
    """Cells as z scores of their feature; features without spread are null."""
    sd = F.stddev_pop("value") if population else F.stddev_samp("value")
    fit = cells.groupBy("feature").agg(F.avg("value").alias("m"), sd.alias("s"))
    return cells.join(fit, "feature").select("entity", "feature", F.when(F.col("s") > least, (F.col("value") - F.col("m")) / F.col("s")).alias("value"))


def rank_normal(cells: DataFrame) -> DataFrame:
    """Cells as normal scores of their mid ranks within their feature."""
    n = cells.groupBy("feature").agg(F.count("value").alias("n"))
    ranked = cells.withColumn("r", average_rank(["feature"], "value")).join(n, "feature")
    return ranked.select("entity", "feature", normal_quantile((F.col("r") - 0.5) / F.col("n")).alias("value"))


#: Surfaces by name, each a function of cells.
SURFACES: dict[str, Callable[[DataFrame], DataFrame]] = {
    "raw": lambda c: c.select("entity", "feature", "value"),
    "column_centred": lambda c: centred(c, rows=False),
    "row_centred": lambda c: centred(c, columns=False),
    "two_way": centred,
    "scaled_two_way": lambda c: centred(scaled(c)),
    "rank_normal_two_way": lambda c: centred(rank_normal(c)),
}


def variance_shares(cells: DataFrame) -> DataFrame:
    """Sums of squares of a complete matrix: entity, feature, interaction, total, and their shares."""
    by_row, by_col, grand = _means(cells)
    each = cells.join(by_row, "entity").join(by_col, "feature").join(grand)
    sq = lambda x: F.sum(x * x)
    r, c, g, v = (F.col(x) for x in ("row_mean", "col_mean", "grand", "value"))
    ss = each.agg(sq(r - g).alias("ss_entity"), sq(c - g).alias("ss_feature"), sq(v - r - c + g).alias("ss_interaction"), sq(v - g).alias("ss_total"))
    return ss.select("*", *[(F.col(f"ss_{x}") / F.col("ss_total")).alias(f"share_{x}") for x in ("entity", "feature", "interaction")])


def fit_features(cells: DataFrame) -> DataFrame:
    """A fit on reference cells, one row a feature: mean, sd, sd of two-way residuals, grand mean, pooled sd."""
    residual = centred(cells).groupBy("feature").agg(F.stddev_samp("value").alias("residual_sd"))
    each = cells.groupBy("feature").agg(F.avg("value").alias("mean"), F.stddev_samp("value").alias("sd"))
    grand = cells.agg(F.avg("value").alias("grand"))
    joined = each.join(residual, "feature").join(grand)
    pooled = joined.agg(F.sqrt(F.avg(F.col("sd") * F.col("sd") + F.pow(F.col("mean") - F.col("grand"), 2))).alias("pooled_sd"))
    return joined.join(pooled)


def represented(cells: DataFrame, fit: DataFrame) -> DataFrame:
    """Score representations of cells under a fit: absolute, feature-centred, two-way, z, scaled residual, prior."""
    rows = cells.groupBy("entity").agg(F.avg("value").alias("row_mean"))
    z_rows = cells.join(fit, "feature").groupBy("entity").agg(F.avg((F.col("value") - F.col("mean")) / F.col("sd")).alias("row_z"))
    x = cells.join(fit, "feature").join(rows, "entity").join(z_rows, "entity")
    two_way = F.col("value") - F.col("mean") - F.col("row_mean") + F.col("grand")
    z = (F.col("value") - F.col("mean")) / F.col("sd")
    return x.select(
        "entity", "feature", F.col("value").alias("absolute"), (F.col("value") - F.col("mean")).alias("feature_centred"), two_way.alias("two_way"),
        z.alias("z"), (z - F.col("row_z")).alias("z_residual"), (two_way / F.col("residual_sd")).alias("scaled_residual"), F.col("mean").alias("prior"),
    )


def fold_local(cells: DataFrame, fold: str, folds: int) -> DataFrame:
    """Cells as z scores by means and sds of all other folds, from per-fold counts, means and centred squares: no pass for each fold. Null where the others have no spread."""
    v, n = F.col("value"), F.col("n")
    part = cells.groupBy("feature", fold).agg(F.count("value").alias("n"), F.coalesce(F.avg(v), F.lit(0.0)).alias("m"), F.coalesce(F.var_pop(v) * F.count("value"), F.lit(0.0)).alias("q"))
    w = Window.partitionBy("feature")
    whole = part.withColumn("all", F.sum("n").over(w)).withColumn("mean", F.try_divide(F.sum(n * F.col("m")).over(w), F.col("all")))
    away = F.col("m") - F.col("mean")
    whole = whole.withColumn("away", away).withColumn("square", F.sum(F.col("q") + n * F.pow(away, 2)).over(w))
    # the other folds' state: the feature's with this fold's taken out
    rest = F.col("all") - n
    m = F.col("mean") - F.try_divide(F.col("away") * n, rest)
    q = F.col("square") - F.col("q") - F.try_divide(F.pow("away", F.lit(2)) * n * F.col("all"), rest)
    fit = whole.select("feature", fold, m.alias("m"), F.sqrt(F.try_divide(F.greatest(q, F.lit(0.0)), rest - 1)).alias("sd"))
    return cells.join(fit, ["feature", fold]).select("entity", "feature", fold, F.try_divide(v - F.col("m"), F.col("sd")).alias("value"))


def row_factor(cells: DataFrame, size: DataFrame) -> DataFrame:
    """Cells over the median ratio of their entity's negative cells to its size: (entity, feature, factor, value)."""
    factor = cells.where(F.col("value") < 0).join(size, "entity").groupBy("entity").agg(F.median(F.col("value") / F.col("size")).alias("factor"))
    return cells.join(factor, "entity").select("entity", "feature", "factor", (F.col("value") / F.col("factor")).alias("value"))


def slope_corrected(cells: DataFrame, covariate: DataFrame) -> DataFrame:
    """Cells less each feature's slope (centred over features) times the entity's standardised covariate x."""
    z = covariate.join(covariate.agg(F.avg("x").alias("m"), F.stddev_samp("x").alias("s"))).select("entity", ((F.col("x") - F.col("m")) / F.col("s")).alias("z"))
    joined = cells.join(z, "entity")
    slope = joined.groupBy("feature").agg(F.regr_slope("value", "z").alias("slope"))
    relative = slope.join(slope.agg(F.avg("slope").alias("all"))).select("feature", "slope", (F.col("slope") - F.col("all")).alias("relative"))
    return joined.join(relative, "feature").select("entity", "feature", "slope", (F.col("value") - F.col("relative") * F.col("z")).alias("value"))


def mixture(cells: DataFrame, alphas: list[float]) -> DataFrame:
    """(alpha, entity, feature, value): (1 - alpha) of the value over its feature's sd plus alpha of the two-way residual."""
    fit = cells.groupBy("feature").agg(F.stddev_samp("value").alias("sd"))
    both = cells.join(fit, "feature").join(centred(cells).withColumnRenamed("value", "residual"), ["entity", "feature"])
    a = F.col("alpha")
    return both.withColumn("alpha", F.explode(F.array(*[F.lit(x) for x in alphas]))).select("alpha", "entity", "feature", ((1 - a) * F.col("value") / F.col("sd") + a * F.col("residual")).alias("value"))


def missing_aware(cells: DataFrame) -> DataFrame:
    """Observed cells as population z scores less the mean of their entity's observed z scores."""
    return centred(scaled(cells.where(F.col("value").isNotNull()), population=True), columns=False)


def reconstruction(cells: DataFrame, size: DataFrame) -> DataFrame:
    """How well each feature follows from its entities' median ratios to `size` over the other features: n, pearson, mae, rmse.

    The median of the others comes from each entity's sorted ratios, an array as long as its row.
    """
    ratio = cells.join(size, "entity").withColumn("ratio", F.col("value") / F.col("size"))
    held = ratio.groupBy("entity").agg(F.first("size").alias("size"), F.collect_list(F.struct("feature", "value", "ratio")).alias("row"))
    one = held.select("entity", "size", "row", F.explode("row").alias("at"))
    others = F.array_sort(F.transform(F.filter("row", lambda x: x["feature"] != F.col("at.feature")), lambda x: x["ratio"]))
    n = F.size("others")
    median = (F.get("others", F.floor((n - 1) / 2).cast("int")) + F.get("others", F.floor(n / 2).cast("int"))) / 2
    guess = one.withColumn("others", others).select(F.col("at.feature").alias("feature"), F.col("at.value").alias("y"), (median * F.col("size")).alias("p"))
    e = F.col("y") - F.col("p")
    return guess.groupBy("feature").agg(F.count("p").alias("n"), F.corr("y", "p").alias("pearson"), F.avg(F.abs(e)).alias("mae"), F.sqrt(F.avg(e * e)).alias("rmse"))


def surface(cells: DataFrame, name: str) -> DataFrame:
    return SURFACES[name](cells)


def named(cells: DataFrame, names: list[str]) -> DataFrame:
    """Several surfaces as one long table with column `surface`."""
    parts = [surface(cells, n).select(F.lit(n).alias("surface"), "entity", "feature", "value") for n in names]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


