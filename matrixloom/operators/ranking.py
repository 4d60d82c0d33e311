"""Within-entity ranking: how scores order an entity's measured features."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ranks import average_rank


def entity_pairs(cells: DataFrame, carried: list[str]) -> DataFrame:
    """Each entity's unordered feature pairs, carried columns as x_<name> and y_<name>.

    Pairs come from each entity's own row of cells, gathered once, so there is one shuffle and no self-join.
    """
    held = cells.groupBy("entity").agg(F.array_sort(F.collect_list(F.struct("feature", *carried))).alias("c"))
    firsts = held.select("entity", "c", F.posexplode("c").alias("at", "x"))
    later = F.slice(F.col("c"), F.col("at") + 2, F.size("c"))
    both = firsts.select("entity", "x", F.explode(later).alias("y"))
    named = [F.col(f"{s}.{c}").alias(f"{s}_{c}") for c in ("feature", *carried) for s in ("x", "y")]
    return both.select("entity", *named)


def credit(measured: Column, score: Column, tie: float = 0.0) -> Column:
    """1 if a score difference orders a measured difference (a lower score means more), 0.5 for equal scores, else 0."""
    return F.when(F.abs(score) <= tie, 0.5).when(F.sign(measured) != F.sign(score), 1.0).otherwise(0.0)


def concordance(pairs: DataFrame, measured: str, score: str, tolerance: float = 0.0, by: list[str] | None = None) -> DataFrame:
    """Mean over entities of their share of ordered pairs, the pair-weighted share, and counts of what was tied or used."""
    by = by or []
    dm, ds = F.col(f"x_{measured}") - F.col(f"y_{measured}"), F.col(f"x_{score}") - F.col(f"y_{score}")
    used = F.abs(dm) > tolerance
    each = pairs.select(*by, "entity", used.alias("used"), F.when(used, credit(dm, ds)).alias("c"), (used & (ds == 0)).alias("tied"))
    per = each.groupBy(*by, "entity").agg(F.avg("c").alias("m"), F.sum("c").alias("s"), F.count("c").alias("n"), F.count_if(~F.col("used")).alias("ties"), F.count_if("tied").alias("score_ties"))
    return per.groupBy(*by).agg(
        F.avg("m").alias("by_entity"), (F.sum("s") / F.sum("n")).alias("by_pair"), F.count("m").alias("entities"),
        F.sum("n").alias("pairs"), F.sum("ties").alias("excluded"), F.sum("score_ties").alias("score_ties"),
    )


def entity_spearman(cells: DataFrame, measured: str, score: str, least: int = 3) -> DataFrame:
    """For each entity of enough cells: Spearman between score and measured value, and whether the best score is a best value."""
    ranked = cells.select("entity", F.col(measured).alias("m"), F.col(score).alias("s"), average_rank(["entity"], measured).alias("rm"), average_rank(["entity"], score).alias("rs"))
    agg = ranked.groupBy("entity").agg(F.count(F.lit(1)).alias("n"), F.corr("rm", "rs").alias("rho"), F.max("m").alias("best"), F.max_by("m", F.struct(-F.col("s"), F.col("m"))).alias("picked"))
    return agg.where(F.col("n") >= least).select("entity", "n", "rho", (F.col("picked") == F.col("best")).cast("int").alias("top1"))


def entity_auc(cells: DataFrame, label: str, score: str) -> DataFrame:
    """For each entity with both labels: the chance that a positive has the lower score, ties half."""
    ranked = cells.select("entity", F.col(label).alias("y"), average_rank(["entity"], score).alias("r"))
    agg = ranked.groupBy("entity").agg(F.sum("y").alias("p"), F.count_if(F.col("y") == 0).alias("q"), F.sum(F.col("r") * F.col("y")).alias("s"))
    auc = 1 - (F.col("s") - F.col("p") * (F.col("p") + 1) / 2) / (F.col("p") * F.col("q"))
    return agg.where("p > 0 AND q > 0").select("entity", auc.alias("auc"))


def retrieval_ranks(cells: DataFrame, label: str, score: str, tops: tuple[int, ...] = (1, 3, 5)) -> DataFrame:
    """Means over an entity's positives, then over entities, of (rank - 1) / (n - 1) and of rank <= top."""
    n = cells.groupBy("entity").agg(F.count(F.lit(1)).alias("n"))
    ranked = cells.withColumn("r", average_rank(["entity"], score)).join(n.where("n > 1"), "entity").where(F.col(label) == 1)
    each = [((F.col("r") - 1) / (F.col("n") - 1)).alias("place"), *[(F.col("r") <= k).cast("int").alias(f"top{k}") for k in tops]]
    names = ["place", *[f"top{k}" for k in tops]]
    per = ranked.select("entity", *each).groupBy("entity").agg(*[F.avg(c).alias(c) for c in names], *[F.sum(c).alias(f"s_{c}") for c in names], F.count(F.lit(1)).alias("c"))
    return per.agg(*[F.avg(c).alias(f"{c}_by_entity") for c in names], *[(F.sum(f"s_{c}") / F.sum("c")).alias(f"{c}_by_pair") for c in names])


def without_own_group(cells: DataFrame, group: str) -> DataFrame:
    """Each cell's feature mean over entities of other groups; the mean of all where no other group has the feature."""
    part = cells.groupBy("feature", group).agg(F.sum("value").alias("s"), F.count("value").alias("n"))
    whole = part.groupBy("feature").agg(F.sum("s").alias("all_s"), F.sum("n").alias("all_n"))
    prior = part.join(whole, "feature").select("feature", group, F.when(F.col("all_n") > F.col("n"), (F.col("all_s") - F.col("s")) / (F.col("all_n") - F.col("n"))).otherwise(F.col("all_s") / F.col("all_n")).alias("prior"))
    return cells.join(prior, ["feature", group]).select("entity", "feature", group, "value", "prior")


def without_self(cells: DataFrame) -> DataFrame:
    """Each cell's feature mean over all other entities."""
    whole = cells.groupBy("feature").agg(F.sum("value").alias("all_s"), F.count("value").alias("all_n"))
    return cells.join(whole, "feature").select("entity", "feature", "value", F.when(F.col("all_n") > 1, (F.col("all_s") - F.col("value")) / (F.col("all_n") - 1)).alias("others"))
