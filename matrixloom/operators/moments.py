"""Mergeable centred moments: counts, means and centred products that tasks build and Spark merges, at any distance of the means from zero."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: A state of a pair of features: weight, both means, what these lack as rounded numbers, centred squares of either, centred product.
STATE = ("n", "mx", "my", "lx", "ly", "cxx", "cyy", "cxy")
#: A spread below this share of the mean is rounding.
RESOLUTION = 1e-13


def _split(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """a + b as a rounded sum and what it lacks, exactly."""
    s = a + b
    t = s - a
    return s, (a - (s - t)) + (b - t)


def batch_state(x: np.ndarray, w: np.ndarray | None = None) -> np.ndarray:
    """The state of all pairs of columns (eight by p by p), over rows where both are seen; rows may have weights.

    Values are taken from their column's mean before they are multiplied, so no digit of the spread is lost to the mean.
    """
    p = x.shape[1]
    w = np.ones(len(x)) if w is None else np.asarray(w, float)
    seen = ~np.isnan(x)
    count = seen.sum(0)
    origin = np.where(count > 0, np.where(seen, x, 0.0).sum(0) / np.maximum(count, 1), 0.0)
    if seen.all():
        n = w.sum()
        z = x - origin
        off = w @ z / n if n else np.zeros(p)
        z = z - off
        c = (w[:, None] * z).T @ z
        (mean, lack), own, one = _split(origin * (n > 0), off), np.diag(c), np.ones(p)
        sides = [m for v in (mean, lack, own) for m in (np.outer(v, one), np.outer(one, v))]
        return np.stack([np.full((p, p), n), *sides, c])
    z, m = np.where(seen, x - origin, 0.0), seen.astype(float)
    wm, wz = w[:, None] * m, w[:, None] * z
    n, s = wm.T @ m, wz.T @ m
    share = np.divide(1.0, n, out=np.zeros_like(n), where=n > 0)
    off = s * share
    square = np.clip((wz * z).T @ m - s * off, 0, None)
    mean, lack = _split(np.where(n > 0, origin[:, None], 0.0), off)
    return np.stack([n, mean, mean.T, lack, lack.T, square, square.T, wz.T @ z - s * off.T])


def joined(a: np.ndarray | None, b: np.ndarray) -> np.ndarray:
    """The state of two disjoint sets of rows; None is the state of no rows."""
    if a is None:
        return b
    n = a[0] + b[0]
    share = np.divide(b[0], n, out=np.zeros_like(n), where=n > 0)
    dx, dy, weight = b[1] - a[1] + (b[3] - a[3]), b[2] - a[2] + (b[4] - a[4]), a[0] * share
    (mx, lx), (my, ly) = _split(a[1], a[3] + dx * share), _split(a[2], a[4] + dy * share)
    return np.stack([n, mx, my, lx, ly, a[5] + b[5] + dx * dx * weight, a[6] + b[6] + dy * dy * weight, a[7] + b[7] + dx * dy * weight])


def merged(parts: DataFrame, keys: list[str], origin: tuple[str, str] | None = None) -> DataFrame:
    """(keys, state): states of disjoint rows merged by key. `lx` and `ly` may be 0 where means are small beside spreads.

    Without `origin` a key's means are taken in a window over its parts, one from each task that had the key, and squares about them added in the
    same exchange. Where a key has many parts, `origin` names columns that hold two numbers near its means, the same for all its parts: then all is sums
    about these, which combine before the exchange.
    """
    n = F.col("n")
    if origin is None:
        w = Window.partitionBy(*keys)
        mean = lambda c: F.coalesce(F.try_divide(F.sum(n * F.col(c)).over(w), F.sum("n").over(w)), F.lit(0.0))
        placed = parts.select(*keys, *STATE, mean("mx").alias("ox"), mean("my").alias("oy"))
    else:
        placed = parts.select(*keys, *STATE, F.col(origin[0]).alias("ox"), F.col(origin[1]).alias("oy"))
    dx, dy = F.col("mx") - F.col("ox") + F.col("lx"), F.col("my") - F.col("oy") + F.col("ly")
    sums = placed.groupBy(*keys).agg(
        F.sum("n").alias("n"), F.max("ox").alias("ox"), F.max("oy").alias("oy"), F.sum(n * dx).alias("sx"), F.sum(n * dy).alias("sy"),
        F.sum(F.col("cxx") + n * dx * dx).alias("cxx"), F.sum(F.col("cyy") + n * dy * dy).alias("cyy"), F.sum(F.col("cxy") + n * dx * dy).alias("cxy"),
    )
    ex, ey = F.coalesce(F.try_divide("sx", "n"), F.lit(0.0)), F.coalesce(F.try_divide("sy", "n"), F.lit(0.0))
    less = {"cxx": F.col("sx") * ex, "cyy": F.col("sy") * ey, "cxy": F.col("sx") * ey}
    centred = {c: F.col(c) - v for c, v in less.items()}
    mx, my = F.col("ox") + ex, F.col("oy") + ey
    squares = [F.greatest(F.lit(0.0), centred[c]).alias(c) for c in ("cxx", "cyy")]
    return sums.select(*keys, "n", mx.alias("mx"), my.alias("my"), (ex - (mx - F.col("ox"))).alias("lx"), (ey - (my - F.col("oy"))).alias("ly"), *squares, centred["cxy"].alias("cxy"))


def weighted(parts: DataFrame, weight: Column) -> DataFrame:
    """States whose rows all count `weight` times."""
    return parts.withColumns({c: F.col(c) * weight for c in ("n", "cxx", "cyy", "cxy")})


def total(of: str) -> Column:
    """The sum of x or y."""
    return F.col("n") * F.col(f"m{of}")


def product_sum() -> Column:
    """The sum of x times y."""
    return F.col("cxy") + F.col("n") * F.col("mx") * F.col("my")


def covariance() -> Column:
    """Sample covariance; null below two rows."""
    return F.try_divide("cxy", F.col("n") - 1)


def correlation() -> Column:
    """Pearson correlation, within [-1, 1]; null where a feature has no spread, judged against its mean."""
    spread = lambda c, m: F.col(c) > F.col("n") * F.pow(F.col(m) * RESOLUTION, 2)
    r = F.col("cxy") / F.sqrt("cxx") / F.sqrt("cyy")
    return F.when(spread("cxx", "mx") & spread("cyy", "my"), F.greatest(F.lit(-1.0), F.least(F.lit(1.0), r)))
