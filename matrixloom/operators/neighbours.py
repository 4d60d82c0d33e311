"""Nearest rows by standardised features."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.tables import stored

#: Features that cells are cut along, distinct rows that a first cell holds on average, and how much wider cells are in each further round.
AXES, HELD, WIDER = 2, 4, 2.0


def _cell(prefix: str, axis: int, width: float) -> Column:
    return F.floor(F.col(f"{prefix}{axis}") / width).cast("long")


def met(rows: DataFrame, asked: DataFrame, axes: int, width: float) -> DataFrame:
    """Pairs of asked rows and rows whose cells of a width touch or are the same: one equi-join of the rows with the asked rows' 3 ** axes cells."""
    around = asked
    for a in range(axes):
        around = around.withColumn(f"_c{a}", F.explode(F.sequence(_cell("_a", a, width) - 1, _cell("_a", a, width) + 1)))
    placed = rows.withColumns({f"_c{a}": _cell("_z", a, width) for a in range(axes)})
    return around.join(placed, [f"_c{a}" for a in range(axes)])


def nearest(pool: DataFrame, key: str, features: list[str], anchors: DataFrame, k: int) -> DataFrame:
    """(anchor, neighbour, rank): each anchor's k nearest pool rows by squared distance of z scores, exactly; equal distances (to nine digits) go by key.

    Rows with equal features are one point that stands for its k + 1 least keys. A round deals points and anchors to cells along AXES features and compares an anchor with the points
    of its own cell and those around it. What isn't there is at least a cell's width away, so an anchor whose kth distance is below that is done; the others go on with
    cells WIDER times as wide, until a cell spans the pool. First cells hold HELD points on average, so few pairs are compared, and crowds of equal rows aren't paired.
    Rows with a null feature or key have no distance and are left out; features without spread count as 0.
    """
    names = range(len(features))
    known = pool.dropna(subset=[key, *features])
    fit = known.agg(F.count(F.lit(1)).alias("n"), *[F.avg(f).alias(f"m{i}") for i, f in enumerate(features)], *[F.stddev_samp(f).alias(f"s{i}") for i, f in enumerate(features)]).first()
    z = [((F.col(f) - fit[f"m{i}"]) / fit[f"s{i}"]) if fit[f"s{i}"] else F.lit(0.0) for i, f in enumerate(features)]
    points = known.select(F.col(key).alias("neighbour"), *[c.alias(f"_z{i}") for i, c in enumerate(z)])
    at = [f"_z{i}" for i in names]
    least = F.row_number().over(Window.partitionBy(*at).orderBy("neighbour"))
    rows = stored(points.withColumn("_n", least).where(F.col("_n") <= k + 1).groupBy(*at).agg(F.collect_list("neighbour").alias("keys")), "points")
    asked = stored(anchors.dropna(subset=[key, *features]).select(F.col(key).alias("anchor"), *[c.alias(f"_a{i}") for i, c in enumerate(z)]), "anchors")
    schema = f"anchor {asked.schema['anchor'].dataType.simpleString()}, neighbour {points.schema['neighbour'].dataType.simpleString()}, rank int"
    axes = min(AXES, len(features))
    ends = rows.agg(F.count(F.lit(1)).alias("n"), *[f(f"_z{a}").alias(f"{e}{a}") for a in range(axes) for e, f in (("low", F.min), ("high", F.max))]).first()
    if not ends["n"]:
        return pool.sparkSession.createDataFrame([], schema)
    reach = asked.agg(*[f(f"_a{a}").alias(f"{e}{a}") for a in range(axes) for e, f in (("low", F.min), ("high", F.max))]).first()
    span = max(max(ends[f"high{a}"], reach[f"high{a}"] or 0.0) - min(ends[f"low{a}"], reach[f"low{a}"] or 0.0) for a in range(axes)) or 1.0
    width = span / max(1.0, (ends["n"] / HELD) ** (1 / axes))
    gap = F.round(reduce(lambda a, b: a + b, [F.pow(F.col(f"_a{i}") - F.col(f"_z{i}"), 2) for i in names]), 9)
    order = Window.partitionBy("anchor").orderBy("gap", "neighbour")
    out = None
    while True:
        pairs = met(rows, asked, axes, width).select("anchor", gap.alias("gap"), F.explode("keys").alias("neighbour")).where("anchor <> neighbour")
        best = pairs.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
        best = stored(best.select("anchor", "neighbour", "gap", "rank"), "nearest")
        if width > span:  # all points are within the cells around
            return best.select("anchor", "neighbour", "rank") if out is None else out.unionByName(best.select("anchor", "neighbour", "rank"))
        sure = best.groupBy("anchor").agg(F.count(F.lit(1)).alias("n"), F.max("gap").alias("worst")).where((F.col("n") == k) & (F.col("worst") < width * width - 2e-9)).select("anchor")
        done = best.join(sure, "anchor", "left_semi").select("anchor", "neighbour", "rank")
        out = done if out is None else out.unionByName(done)
        asked = stored(asked.join(sure, "anchor", "left_anti"), "anchors")
        if asked.isEmpty():
            return out
        width *= WIDER
