"""Linear models from centred moments, which Spark merges over entities; small systems are solved on the driver."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


#: Rows, means of all columns, and their centred products.
Moments = tuple[float, np.ndarray, np.ndarray]


def _state(z: np.ndarray, w: np.ndarray | None) -> Moments:
    w = np.ones(len(z)) if w is None else w
    n = float(w.sum())
    origin = z.mean(0)
    mean = origin + w @ (z - origin) / n if n else origin
    d = z - mean
    return n, mean, (w[:, None] * d).T @ d


def together(a: Moments | None, b: Moments) -> Moments:
    """The moments of two disjoint sets of rows; None has no rows."""
    if a is None or not a[0]:
        return b
    n, d = a[0] + b[0], b[1] - a[1]
    return n, a[1] + d * (b[0] / n), a[2] + b[2] + np.outer(d, d) * (a[0] * b[0] / n)


def without(a: Moments, b: Moments) -> Moments:
    """The moments of the rows of `a` that aren't in its part `b`."""
    n, d = a[0] - b[0], b[1] - a[1]
    return n, a[1] - d * (b[0] / n), a[2] - b[2] - np.outer(d, d) * (b[0] * a[0] / n)


def normal_moments(rows: DataFrame, x: list[str], y: list[str], by: str | None = None, weight: str | None = None) -> dict[int, Moments]:
    """For each value of `by` the moments of the columns (x, y), rows with a null left out: one small state a task, merged in Spark by `by`.

    `by` holds a bounded number of values (folds).
    """
    names = [*x, *y]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict = {}
        for b in batches:
            for key, part in b.groupby(by) if by else [(0, b)]:
                if len(part):
                    held[key] = together(held.get(key), _state(part[names].to_numpy(float), part[weight].to_numpy(float) if weight else None))
        for key, (n, m, c) in held.items():
            yield pd.DataFrame({"by": [int(key)], "n": [n], "m": [m], "c": [c.ravel()]})

    def merge(part: pd.DataFrame) -> pd.DataFrame:
        held = None
        for n, m, c in zip(part["n"], part["m"], part["c"], strict=True):
            held = together(held, (n, np.asarray(m), np.asarray(c).reshape(len(names), -1)))
        return pd.DataFrame({"by": part["by"].iloc[:1], "n": [held[0]], "m": [held[1]], "c": [held[2].ravel()]})

    schema = "by long, n double, m array<double>, c array<double>"
    used = rows.select(*names, *([by] if by else []), *([weight] if weight else [])).dropna()
    found = used.mapInPandas(run, schema).groupBy("by").applyInPandas(merge, schema).collect()
    return {r["by"]: (r["n"], np.array(r["m"]), np.array(r["c"]).reshape(len(names), -1)) for r in found}


def solve(m: Moments, x: int, ridge: float = 0.0) -> np.ndarray:
    """Coefficients (1 + x rows, one column for each response) from the moments of x predictors and the responses; the constant isn't penalised."""
    _, mean, c = m
    a = c[:x, :x] + ridge * np.eye(x)
    scale = 1 / np.sqrt(np.where(np.diag(a) > 0, np.diag(a), 1.0))
    b = scale[:, None] * np.linalg.lstsq(a * np.outer(scale, scale), scale[:, None] * c[:x, x:], rcond=None)[0]
    return np.vstack([mean[x:] - mean[:x] @ b, b])


def held_out(rows: DataFrame, x: list[str], y: list[str], fold: str, ridge: float = 0.0) -> DataFrame:
    """`rows` with p_<response>: each row predicted by the model of all other folds, from per-fold moments in one pass."""
    parts = normal_moments(rows, x, y, fold)
    whole = None
    for m in parts.values():
        whole = together(whole, m)
    fits = {f: solve(without(whole, m), len(x), ridge) for f, m in parts.items()}

    def predicted(k: int) -> Column:
        out = F.lit(None).cast("double")
        for f, b in fits.items():
            value = F.lit(float(b[0, k]))
            for i, name in enumerate(x):
                value = value + F.col(name) * float(b[i + 1, k])
            out = F.when(F.col(fold) == f, value).otherwise(out)
        return out

    return rows.withColumns({f"p_{name}": predicted(k) for k, name in enumerate(y)})


def bases_r2(rows: DataFrame, bases: dict[str, list[str]], y: str, fold: str) -> dict[str, float]:
    """Out-of-fold R2 of a response by each basis on the same folds: rows are read once, for the moments of all columns.

    A basis takes its part of the moments; a fold's squared error is a quadratic form of its own centred products, plus what its means miss.
    """
    names = sorted({c for x in bases.values() for c in x})
    parts = normal_moments(rows, names, [y], fold)
    out = {}
    for basis, x in bases.items():
        at = [*[names.index(c) for c in x], len(names)]
        part = {f: (n, m[at], c[np.ix_(at, at)]) for f, (n, m, c) in parts.items()}
        every, error = None, 0.0
        for m in part.values():
            every = together(every, m)
        for m in part.values():
            b = solve(without(every, m), len(x))[:, 0]
            e = np.append(-b[1:], 1.0)
            error += float(e @ m[2] @ e + m[0] * (e @ m[1] - b[0]) ** 2)
        out[basis] = 1 - error / float(every[2][-1, -1])
    return out


def out_of_fold_r2(df: DataFrame, y: str, p: str, by: list[str] | None = None) -> DataFrame:
    """1 - SSE / SST."""
    mean = df.groupBy(*(by or [])).agg(F.avg(y).alias("_m"))
    x = df.join(mean, by) if by else df.join(mean)
    e, d = F.col(y) - F.col(p), F.col(y) - F.col("_m")
    return x.groupBy(*(by or [])).agg((1 - F.sum(e * e) / F.sum(d * d)).alias("r2"))


def partial(r_xy: Column, r_xc: Column, r_yc: Column) -> Column:
    """Correlation of x and y with c held fixed."""
    return (r_xy - r_xc * r_yc) / F.sqrt((1 - r_xc * r_xc) * (1 - r_yc * r_yc))


def two_predictors(r_y1: Column, r_y2: Column, r_12: Column) -> dict[str, Column]:
    """Standardised coefficients, joint and semipartial R2 of two predictors, from correlations."""
    d = 1 - r_12 * r_12
    b1, b2 = (r_y1 - r_y2 * r_12) / d, (r_y2 - r_y1 * r_12) / d
    joint = b1 * r_y1 + b2 * r_y2
    return {"beta_1": b1, "beta_2": b2, "joint_r2": joint, "unique_1": joint - r_y2 * r_y2, "unique_2": joint - r_y1 * r_y1}


def projected(df: DataFrame, counts: str, width: int, seed: int) -> DataFrame:
    """`projection`: an array of sparse counts (map of bin to count) times a random sign matrix given by hashes."""
    sign = lambda b, k: F.when(F.xxhash64(F.lit(seed), b, k) > 0, 1.0).otherwise(-1.0)
    entry = lambda k: F.aggregate(F.map_entries(counts), F.lit(0.0), lambda a, e: a + sign(e["key"], k) * e["value"])
    return df.withColumn("projection", F.transform(F.sequence(F.lit(0), F.lit(width - 1)), lambda k: entry(k) / width**0.5))
