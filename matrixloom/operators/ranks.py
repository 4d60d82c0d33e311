"""Ranks, labels of upper tails, cumulative rules, bins and set counts."""

from __future__ import annotations

from collections.abc import Callable
from statistics import NormalDist

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.tables import stored


def average_rank(by: list, value: str) -> Column:
    """Rank from 1 within groups; ties share their mean rank."""
    ties = Window.partitionBy(*by, value)
    return F.rank().over(Window.partitionBy(*by).orderBy(value)) + (F.count(F.lit(1)).over(ties) - 1) / 2


def dealt(value: str, edges: list[float]) -> Column:
    """The number of a value's range: odd for values equal to an edge, so that a value of very many rows has a range of its own."""

    def halved(low: int, high: int) -> str:
        if low == high:
            return str(2 * low)
        at = (low + high) // 2
        return f"IF(`{value}` > double('{edges[at]!r}'), {halved(at + 1, high)}, IF(`{value}` = double('{edges[at]!r}'), {2 * at + 1}, {halved(low, at)}))"

    return F.expr(halved(0, len(edges)))


def range_edges(df: DataFrame, value: str, parts: int = 64) -> list[float]:
    """Distinct approximate quantiles that cut a column into about `parts` ranges."""
    return sorted(set(df.select(F.col(value).cast("double").alias("v")).approxQuantile("v", [i / parts for i in range(1, parts)], 0.5 / parts)))


def ranged(df: DataFrame, by: list[str], order: list[Column], parts: int | None = None) -> DataFrame:
    """`df` with `_part`, its rows dealt to ranges of group and order: `parts`, or as many as their size asks for. Stored, so that they stay as they are."""
    return stored(df.repartitionByRange(*([parts] if parts else []), *[F.col(c).asc() for c in by], *order).withColumn("_part", F.spark_partition_id()), "ranges")


def carried(parts: DataFrame, by: list[str], order: list[Column], name: str, value: Column, how: Callable[[Column], Column] = F.sum) -> DataFrame:
    """`parts` (of `ranged`) with `name`: the sum (or greatest) of a value over the rows of the group up to and with each, in order.

    A window over the rows of a range, and what earlier ranges of the group hold, from one row for each range: no task holds a group.
    """
    rows = parts.withColumn("_carried", value)
    inside = Window.partitionBy(*by, "_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    earlier = Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    before = rows.groupBy(*by, "_part").agg(how("_carried").alias("_held")).select(*by, "_part", how("_held").over(earlier).alias("_earlier"))
    both = rows.withColumn("_within", how("_carried").over(inside)).join(before, [*by, "_part"])
    total = F.greatest("_within", "_earlier") if how is F.max else F.col("_within") + F.coalesce("_earlier", F.lit(0))
    return both.withColumn(name, total).drop("_carried", "_within", "_earlier")


def cumulated(df: DataFrame, value: str, by: list[str] | None = None, parts: int | None = None) -> DataFrame:
    """(by, value, n, upto): each distinct value's rows, and the rows of its group up to and with it.

    Distinct values are counted first and then dealt to ranges (`ranged`), as many as they need; a sum within a range and the
    sums of lower ranges make `upto`, so no task holds all values of a group. Null values are left out.
    """
    by = by or []
    n = df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count(F.lit(1)).alias("n"))
    order = [F.col(value).asc()]
    return carried(ranged(n, by, order, parts), by, order, "upto", F.col("n")).select(*by, value, "n", "upto")


def value_ranks(df: DataFrame, value: str, by: list[str] | None = None, parts: int | None = None) -> DataFrame:
    """(by, value, rank): average rank of each distinct value, without a task that holds all values of a group."""
    return cumulated(df, value, by, parts).select(*(by or []), value, (F.col("upto") - (F.col("n") - 1) / 2).alias("rank"))


def with_rank(df: DataFrame, value: str, by: list[str], name: str) -> DataFrame:
    """The rows that have a value, with its average rank in their group."""
    return df.join(value_ranks(df, value, by).withColumnRenamed("rank", name), [*by, value])


def quantiles(df: DataFrame, value: str, shares: dict[str, float], by: list[str] | None = None) -> DataFrame:
    """(by, a column a share): exact linear quantiles, from cumulated counts of distinct values; groups without a value are left out."""
    by = by or []
    c = cumulated(df, value, by)
    total = c.groupBy(*by).agg(F.max("upto").alias("_all"))
    rows = c.join(total, by) if by else c.join(F.broadcast(total))
    place = {name: F.lit(share) * (F.col("_all") - 1) for name, share in shares.items()}
    reach = lambda at: F.min(F.when(F.col("upto") > at, F.col(value).cast("double")))
    ends = [e for name, at in place.items() for e in (reach(F.floor(at)).alias(f"_{name}_low"), reach(F.ceil(at)).alias(f"_{name}_high"))]
    found = rows.groupBy(*by, "_all").agg(*ends)
    between = lambda name, at: F.col(f"_{name}_low") + (F.col(f"_{name}_high") - F.col(f"_{name}_low")) * (at - F.floor(at))
    return found.select(*by, *[between(name, at).alias(name) for name, at in place.items()])


def numbered(df: DataFrame, by: list[str], order: str, name: str = "k", parts: int | None = None) -> DataFrame:
    """`name`: each row's number from 0 in a group by `order`, whose values deal the rows of all groups to ranges."""
    step = [F.col(order).asc()]
    rows = carried(ranged(df, by, step, parts), by, step, "_k", F.lit(1))
    return rows.withColumn(name, F.col("_k") - 1).select(*df.columns, name)


def percentile_ranks(df: DataFrame, value: str, by: list[str]) -> DataFrame:
    """The rows with their rank as r / n (`of_n`), (r - 0.5) / n (`mid`) and (r - 1) / (n - 1) (`closed`). Rows without a value go."""
    c = cumulated(df, value, by)
    rows = df.join(c, [*by, value]).join(c.groupBy(*by).agg(F.max("upto").alias("_all")), by)
    r = F.col("upto") - (F.col("n") - 1) / 2
    return rows.select(*df.columns, (r / F.col("_all")).alias("of_n"), ((r - 0.5) / F.col("_all")).alias("mid"), ((r - 1) / (F.col("_all") - 1)).alias("closed"))


@F.pandas_udf(T.DoubleType())
def normal_quantile(p: pd.Series) -> pd.Series:
    """The standard normal quantile of a probability."""
    return p.map(NormalDist().inv_cdf)


def upper_tail(df: DataFrame, value: str, position: str, share: float, later_wins: bool = True) -> DataFrame:
    """`label`: 1 for the ceil(share * n) greatest values, at least one. Among ties the later (or earlier) position wins.

    One window ranks all rows: for pair tables and other small ones; `upper_cuts` finds the cut of a large one.
    """
    k = F.greatest(F.lit(1), F.ceil(F.count(F.lit(1)).over(Window.partitionBy()) * F.lit(share)))
    order = Window.orderBy(F.desc(value), F.desc(position) if later_wins else F.asc(position))
    return df.withColumn("_k", k).withColumn("label", (F.row_number().over(order) <= F.col("_k")).cast("int")).drop("_k")


def holm(df: DataFrame, p: str, order: str) -> DataFrame:
    """`adjusted`: Holm's step-down p, at most 1, never falling along the sorted p; of equal p the first by `order` comes first."""
    step = [F.col(p).asc(), F.col(order).asc()]
    rows = carried(ranged(df, [], step), [], step, "_k", F.lit(1))
    count = rows.agg(F.count(F.lit(1)).alias("_n"))
    raw = F.least(F.lit(1.0), F.col(p) * (F.col("_n") - F.col("_k") + 1))
    return carried(rows.join(F.broadcast(count)), [], step, "adjusted", raw, F.max).select(*df.columns, "adjusted")


def quantile_bins(df: DataFrame, value: str, bins: int) -> DataFrame:
    """`bin` from 0, closed on the right, at exact linear quantiles; equal edges raise."""
    edges = list(quantiles(df, value, {f"e{i}": i / bins for i in range(1, bins)}).first())
    if len(set(edges)) < len(edges):
        raise ValueError("tied bin edges")
    number = F.lit(bins - 1)
    for i in reversed(range(bins - 1)):
        number = F.when(F.col(value) <= edges[i], F.lit(i)).otherwise(number)
    return df.withColumn("bin", number)


def extremes(df: DataFrame, value: str, share: float) -> DataFrame:
    """`side`: -1 at or below the lower quantile, 1 at or above the upper, else 0; the sides may not meet."""
    low, high = quantiles(df, value, {"low": share, "high": 1 - share}).first()
    if low >= high:
        raise ValueError("the extremes overlap")
    return df.withColumn("side", F.when(F.col(value) <= low, -1).when(F.col(value) >= high, 1).otherwise(0))


def set_counts(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Distinct keys in both, in either and in each alone, without null and empty ones; Jaccard index."""
    one = a.select(key).where(F.col(key).isNotNull() & (F.col(key).cast("string") != "")).select(F.col(key), F.lit(1).alias("a"), F.lit(0).alias("b"))
    two = b.select(key).where(F.col(key).isNotNull() & (F.col(key).cast("string") != "")).select(F.col(key), F.lit(0).alias("a"), F.lit(1).alias("b"))
    each = one.union(two).groupBy(key).agg(F.max("a").alias("a"), F.max("b").alias("b"))
    both = F.sum(F.col("a") * F.col("b"))
    return each.agg(both.alias("shared"), F.count(F.lit(1)).alias("either"), (F.sum("a") - both).alias("only_a"), (F.sum("b") - both).alias("only_b"), (both / F.count(F.lit(1))).alias("jaccard"))


def shared_counts(members: DataFrame, owner: str, item: str, crowd: int = 256) -> DataFrame:
    """(one, other, n): in how many items each pair of owners meets, from distinct rows; pairs that never meet are left out."""
    return met_pairs(members, owner, item, crowd).select("one", "other", "n")


def met_pairs(members: DataFrame, owner: str, item: str, crowd: int = 256, few: int = 1024, held: int = 2_000_000) -> DataFrame:
    """(one, other, one_items, other_items, n): each pair of owners that meets in an item, the number of items of each, and in how many they meet, from distinct rows.

    An item of over `crowd` owners is split: each of its owners meets every slice, a slice holds about `crowd` owners. Pairs of up to `few` owners are counted where they
    are made, before they are shuffled. Those of more owners seldom meet twice in a task, so what is shuffled is an owner with the list of those
    that it meets in a slice, dealt by owner (and parts of the others, for an owner of very many items); its pairs become rows where they are counted, about `held` in a task.
    """
    members = stored(members.select(owner, item), "members")
    own = stored(members.groupBy(F.col(owner).alias("_o")).agg(F.count(F.lit(1)).alias("_n")), "owner-items")
    size = stored(members.groupBy(F.col(item).alias("_item")).agg(F.count(F.lit(1)).alias("_owners")), "item-owners")
    m = members.select(F.col(item).alias("_item"), F.col(owner).alias("_o")).join(own, "_o").join(size.withColumn("_slices", F.ceil(F.col("_owners") / crowd).cast("int")), "_item")
    a = m.select("_item", F.col("_o").alias("one"), F.col("_n").alias("one_items"), F.explode(F.sequence(F.lit(0), F.col("_slices") - 1)).alias("_slice"))
    b = m.select("_item", F.struct(F.col("_o").alias("other"), F.col("_n").alias("other_items")).alias("_b"), F.pmod(F.xxhash64("_o"), F.col("_slices")).cast("int").alias("_slice"))
    key = ["one", "other", "one_items", "other_items"]
    if own.count() <= few:
        met = a.join(b, ["_item", "_slice"]).where(F.col("one") < F.col("_b.other")).select("one", "one_items", "_b.*")
        return met.groupBy(*key).agg(F.count(F.lit(1)).alias("n"))
    pairs = size.agg(F.sum(F.col("_owners").cast("double") * (F.col("_owners") - 1) / 2)).first()[0]
    tasks = max(members.sparkSession.sparkContext.defaultParallelism, int(pairs / held) + 1)
    lists = b.groupBy("_item", "_slice").agg(F.collect_list("_b").alias("_b"))
    after = a.join(lists, ["_item", "_slice"]).select("one", "one_items", F.filter("_b", lambda x: x["other"] > F.col("one")).alias("_b")).where(F.size("_b") > 0)
    parts = F.ceil(F.col("one_items") / 100_000).cast("int")
    dealt = after.withColumn("_part", F.explode(F.sequence(F.lit(0), parts - 1)))
    some = F.filter("_b", lambda x: (F.col("one_items") <= 100_000) | (F.pmod(F.xxhash64(x["other"]), parts) == F.col("_part")))
    thin = dealt.select("one", "one_items", "_part", some.alias("_b")).select("one", "one_items", "_part", F.col("_b.other").alias("other"), F.col("_b.other_items").cast("array<int>").alias("other_items"))
    rows = thin.repartition(tasks, "one", "_part").select("one", "one_items", "_part", F.explode(F.arrays_zip("other", "other_items")).alias("_b"))
    counted = rows.select("one", "one_items", "_part", "_b.other", "_b.other_items").groupBy("_part", *key).agg(F.count(F.lit(1)).alias("n"))
    return counted.select("one", "other", "one_items", F.col("other_items").cast("long").alias("other_items"), "n")


def upper_cuts(df: DataFrame, value: str, tenths: list[int], width: int = 256) -> DataFrame:
    """(tenths, cut): the value from which the upper fraction of all rows with a value goes, ties at the cut included.

    Counts of distinct values are summed within ranges of `width`, and over the few ranges.
    """
    c = df.where(F.col(value).isNotNull()).groupBy(F.col(value).alias("_v")).agg(F.count(F.lit(1)).alias("_c")).withColumn("_b", F.floor(F.col("_v") / width))
    own = c.groupBy("_b").agg(F.sum("_c").alias("_n"))
    above = own.select("_b", (F.sum("_n").over(Window.orderBy(F.desc("_b"))) - F.col("_n")).alias("_above"), F.sum("_n").over(Window.partitionBy()).alias("_all"))
    down = F.sum("_c").over(Window.partitionBy("_b").orderBy(F.desc("_v"))) + F.col("_above")
    reached = c.join(F.broadcast(above), "_b").select("_v", "_all", down.alias("_reached"))
    each = reached.withColumn("tenths", F.explode(F.array(*map(F.lit, tenths)))).where(F.col("_reached") * 10 >= F.col("_all") * F.col("tenths"))
    return each.groupBy("tenths").agg(F.max("_v").alias("cut"))
