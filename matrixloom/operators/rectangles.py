"""The largest complete rectangle of a score matrix: a depth-first search with bounds, dealt to tasks by beginnings of feature sets."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.tables import stored

#: Distinct rows of one beginning up to which a task searches it; more are split by another feature.
ROWS = 1 << 17
#: Features of a first beginning.
DEPTH = 2


class Search:
    """Sets of features over distinct rows (0 or 1) that stand for `weight` entities each: the best one that has at least `least` entities.

    More features win, then more entities, then the first set in declared order. A set grows by features that follow in search order. What all its rows
    have is taken at once; a branch ends where not even all features that still reach `least`, or as many as enough rows have of them, make a set
    as good as the best.
    """

    def __init__(self, have: np.ndarray, weight: np.ndarray, declared: np.ndarray, begun: list[int], least: int, best: tuple[int, float] = (0, 0)):
        self.have, self.weight, self.declared, self.least = have, weight, declared, least
        self.best: tuple = (*best, None)
        self.begun = begun

    def _offer(self, chosen: list[int], entities: float) -> None:
        members = sorted(self.begun + [int(self.declared[k]) for k in chosen])
        size, most, first = self.best
        if (len(members), entities) > (size, most) or (len(members), entities) == (size, most) and (first is None or members < first):
            self.best = (len(members), entities, members)

    def _open(self, chosen: list[int], rows: np.ndarray, more: np.ndarray) -> tuple[list[int], np.ndarray, np.ndarray, float, bool]:
        """The set with what all its rows have, the features that may follow, their entities, its entities, and whether it can still win."""
        w = self.weight[rows]
        total = w.sum()
        held = w @ self.have[np.ix_(rows, more)]
        chosen = chosen + more[held == total].tolist()
        some = (held >= self.least) & (held < total)
        more, held = more[some], held[some]
        self._offer(chosen, float(total))
        size = len(self.begun) + len(chosen)
        reach = min(len(more), self._bound(rows, w, more)) if len(more) else 0
        return chosen, more, held, float(total), (size + reach, total) >= self.best[:2]

    def _bound(self, rows: np.ndarray, w: np.ndarray, more: np.ndarray) -> int:
        """The most of the features that at least `least` entities have so many of."""
        n = self.have[np.ix_(rows, more)].sum(1).astype(np.int64)
        upto = np.cumsum(np.bincount(n, weights=w, minlength=len(more) + 1)[::-1])[::-1]
        return int(np.flatnonzero(upto >= self.least)[-1])

    def run(self, greedy: bool = False) -> tuple:
        """The best set; with `greedy` only the commonest feature is followed, which gives a first bound."""
        all_rows = np.arange(len(self.have))
        if self.weight.sum() < self.least:
            return self.best
        stack = [([], all_rows, np.arange(self.have.shape[1]))]
        while stack:
            chosen, rows, more = stack.pop()
            chosen, more, held, _, open_ = self._open(chosen, rows, more)
            if not open_ or not len(more):
                continue
            at = [int(held.argmax())] if greedy else range(len(more))
            for k in reversed(at):  # the rarest first, whose branches are the smallest
                rest = np.delete(more, k) if greedy else more[k + 1 :]
                if greedy or (len(self.begun) + len(chosen) + 1 + len(rest), held[k]) >= self.best[:2]:
                    stack.append(([*chosen, int(more[k])], rows[self.have[rows, more[k]] > 0], rest))
        return self.best


def _searched(least: int, names: int, best: tuple[int, float], greedy: bool) -> Callable[[pd.DataFrame], pd.DataFrame]:
    def run(part: pd.DataFrame) -> pd.DataFrame:
        begun, last = [int(v) for v in part["begun"].iloc[0]], int(part["last"].iloc[0])
        columns = names - last - 1
        have = np.zeros((len(part), columns), np.float64)
        for k, rest in enumerate(part["rest"]):
            have[k, np.asarray(rest, np.int64) - last - 1] = 1
        order = np.asarray(part["declared"].iloc[0], np.int64)
        found = Search(have, part["n"].to_numpy(float), order[last + 1 :], [int(order[b]) for b in begun], least, best).run(greedy)
        return pd.DataFrame({"size": [found[0]], "entities": [int(found[1])], "members": [found[2]]})

    return run


def largest_complete(cells: DataFrame, features: list, least: int, rows: int = ROWS, depth: int = DEPTH) -> DataFrame:
    """(features, entities, members): the largest set of the given features that at least `least` entities have in full; no row if there is none.

    `members` marks the declared features by 1 and 0. Of equal sizes more entities win, then the first set in declared order. Entities are counted by the set of
    features that they have. Each such set is dealt to the beginnings (of `depth` features, the rarest first) that it holds, as what is left of it, and counted again.
    A beginning with more than `rows` distinct rests is split by another feature, so no task searches more. One search that follows the commonest
    features gives the bound that all begin with; only supports of single features and one best set a beginning come to the driver.
    """
    known = cells.where(F.col("value").isNotNull() & F.col("feature").isin(features)).select("entity", "feature").distinct()
    support = {r["feature"]: r["n"] for r in known.groupBy("feature").agg(F.count(F.lit(1)).alias("n")).collect()}
    order = sorted((i for i, f in enumerate(features) if support.get(f, 0) >= least), key=lambda i: (support[features[i]], i))
    spark = cells.sparkSession
    schema = "features int, entities long, members string"
    if not order:
        return spark.createDataFrame([], schema)
    place = F.create_map(*[F.lit(x) for k, i in enumerate(order) for x in (features[i], k)])
    sets = known.where(F.col("feature").isin([features[i] for i in order])).groupBy("entity").agg(F.array_sort(F.collect_list(place[F.col("feature")])).alias("rest"))
    now = sets.groupBy("rest").agg(F.count(F.lit(1)).alias("n")).select(F.array().cast("array<int>").alias("begun"), "rest", "n")
    now = stored(now, "feature-sets")
    kept, offered = None, []
    for step in range(len(order)):
        parts = now.groupBy("begun").agg(F.count(F.lit(1)).alias("many"), F.sum("n").alias("all")).where(F.col("all") >= least)
        parts = parts.withColumn("split", (F.col("many") > rows) | F.lit(step < depth))
        dealt = now.join(parts, "begun")
        if step:  # what is split is offered as it is too
            declared = F.array_sort(F.transform("begun", lambda k: F.get(F.array(*map(F.lit, order)), k)))
            best = parts.where("split").select("all", declared.alias("members")).orderBy(F.desc("all"), "members").limit(1).collect()
            offered += [(step, r["all"], list(r["members"])) for r in best]
        small = dealt.where("not split").select("begun", "rest", "n")
        kept = small if kept is None else kept.union(small)
        wide = dealt.where("split").select("begun", "n", "rest", F.posexplode("rest").alias("at", "next"))
        wide = wide.select(F.array_append("begun", F.col("next")).alias("begun"), F.slice("rest", F.col("at") + 2, F.size("rest")).alias("rest"), "n")
        now = stored(wide.groupBy("begun", "rest").agg(F.sum("n").alias("n")), "feature-sets")
        if now.isEmpty():
            break
    group = kept.withColumns({"last": F.element_at("begun", -1), "declared": F.array(*map(F.lit, order))}).repartition("begun")
    group = stored(group, "feature-beginnings")
    found = "size int, entities long, members array<int>"
    search = lambda best, greedy: group.groupBy("begun").applyInPandas(_searched(least, len(order), best, greedy), found).where("members IS NOT NULL").collect()
    offered.append(max(((1, support[features[i]], [i]) for i in order), key=lambda s: (s[1], -s[2][0])))
    pairs = [(r["size"], r["entities"], list(r["members"])) for r in search((0, 0), True)]
    bound = max([*offered, *pairs], key=lambda s: s[:2])
    all_found = [*offered, *pairs, *((r["size"], r["entities"], list(r["members"])) for r in search(bound[:2], False))]
    size, entities, members = min(all_found, key=lambda s: (-s[0], -s[1], s[2]))
    return spark.createDataFrame([(size, entities, "".join("01"[i in members] for i in range(len(features))))], schema)
