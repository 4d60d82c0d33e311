"""Optimal one-to-one assignment: many independent problems, one a group, each solved where its costs are."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import types as T


def assigned(cost: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(column of each row, row prices, column prices) of least total cost for a matrix with no more rows than columns.

    Rows enter one by one; a shortest path of reduced costs from the new row to a free column moves the rows along it. No reduced cost
    (cost less both prices) is below 0 and those of the assignment are 0, which proves that no other total is less.
    """
    rows, columns = cost.shape
    if rows > columns:
        raise ValueError("more rows than columns")
    u, v, of = np.zeros(rows), np.zeros(columns), np.full(columns, -1)
    for new in range(rows):
        best, came, closed = np.full(columns, np.inf), np.full(columns, -1), np.zeros(columns, bool)
        row, at, far = new, -1, 0.0
        while True:
            step = far + cost[row] - u[row] - v
            better = ~closed & (step < best)
            best[better], came[better] = step[better], at
            at = int(np.where(closed, np.inf, best).argmin())
            far, closed[at] = best[at], True
            if of[at] < 0:
                break
            row = of[at]
        u[new] += far
        inner = closed & (of >= 0)
        u[of[inner]] += far - best[inner]
        v[closed] -= far - best[closed]
        while at >= 0:
            before = came[at]
            of[at] = of[before] if before >= 0 else new
            at = before
    out = np.empty(rows, np.int64)
    out[of[of >= 0]] = np.flatnonzero(of >= 0)
    return out, u, v


def assign(costs: DataFrame, by: list[str], within: float = 1e-9) -> DataFrame:
    """(by, i, j, cost): for each group of a cost table (by, i, j, cost) the assignment of least total; i and j number rows and columns.

    A group is one problem, of features squared; groups spread over tasks. Costs that are missing or null can't be taken; raises where no assignment is left, or where the prices don't
    prove the total to be the least.
    """

    def run(part: pd.DataFrame) -> pd.DataFrame:
        part = part.dropna(subset=["cost"])
        rows, i = np.unique(part["i"].to_numpy(), return_inverse=True)
        columns, j = np.unique(part["j"].to_numpy(), return_inverse=True)
        known = part["cost"].to_numpy(float)
        wall = (np.abs(known).sum() + 1) * (len(rows) + 1)
        cost = np.full((len(rows), len(columns)), wall)
        cost[i, j] = known
        to, u, v = assigned(cost)
        taken = cost[np.arange(len(rows)), to]
        if (taken >= wall).any():
            raise ValueError("no assignment without missing costs")
        slack = cost - u[:, None] - v
        if slack.min() < -within * wall or np.abs(slack[np.arange(len(rows)), to]).max() > within * wall:
            raise ValueError("the assignment isn't proven")
        return pd.DataFrame({b: [part[b].iloc[0]] * len(rows) for b in by} | {"i": rows, "j": columns[to], "cost": taken})

    fields = [costs.schema[c] for c in (*by, "i", "j")] + [T.StructField("cost", T.DoubleType())]
    return costs.select(*by, "i", "j", "cost").groupBy(*by).applyInPandas(run, T.StructType(fields))
