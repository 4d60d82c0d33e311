"""Missing cells from conditional regressions on all observed features, fitted on moments that rounds bring to rest; boosted trees beside linear models."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.tables import stored
from .geometry import rows_of, values_of


def _expected(x: np.ndarray, mean: np.ndarray, cov: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(rows, filled, spread) for each set of observed features: what a normal law expects of missing values, and their summed conditional covariance."""
    seen = ~np.isnan(x)
    keys, of = np.unique(seen, axis=0, return_inverse=True)
    of = of.ravel()
    for k, has in enumerate(keys):
        rows = np.flatnonzero(of == k)
        o, m = np.flatnonzero(has), np.flatnonzero(~has)
        full, spread = x[rows].copy(), np.zeros(cov.shape)
        if len(m):
            b = np.linalg.lstsq(cov[np.ix_(o, o)], cov[np.ix_(o, m)], rcond=None)[0] if len(o) else np.zeros((0, len(m)))
            full[:, m] = mean[m] + (full[:, o] - mean[o]) @ b
            spread[np.ix_(m, m)] = len(rows) * (cov[np.ix_(m, m)] - cov[np.ix_(m, o)] @ b)
        yield rows, full, spread


def fitted_law(rows: DataFrame, features: int, ridge: float = 1.0, rounds: int = 200, within: float = 1e-4) -> tuple[np.ndarray, np.ndarray, int]:
    """(means, covariances, rounds taken) of a normal law fitted to rows with gaps, by rounds of expectation and refitting.

    In a round each task fills its rows by the regressions that the present law gives, and sums the filled rows and their products from the present means, with
    what the gaps leave uncertain: one table of features squared a task, whatever the rows. `ridge` rows of uncorrelated features with
    the observed variances count among the rows. It ends when no mean or covariance moves by more than `within` deviations; raises if `rounds` aren't enough.
    """
    p = features
    own = rows.agg(*[f(F.get("x", F.lit(k))).alias(f"{n}{k}") for k in range(p) for n, f in (("m", F.avg), ("v", F.var_pop), ("c", F.count))]).first()
    if any(not own[f"c{k}"] for k in range(p)):
        raise ValueError("a feature has no observed cell")
    mean, variance = np.array([own[f"m{k}"] for k in range(p)]), np.array([own[f"v{k}"] or 1e-12 for k in range(p)])
    cov, scale = np.diag(variance), np.sqrt(variance)
    for t in range(1, rounds + 1):

        def run(batches: Iterator[pa.RecordBatch], mean=mean, cov=cov) -> Iterator[pa.RecordBatch]:
            total = np.zeros(1 + p + p * p)
            for b in batches:
                if len(b):
                    for some, full, spread in _expected(values_of(b.column(0), p), mean, cov):
                        z = full - mean
                        total += np.concatenate([[len(some)], z.sum(0), (z.T @ z + spread).ravel()])
            yield pa.RecordBatch.from_arrays([pa.array([total], pa.list_(pa.float64()))], ["s"])

        sums = rows.select("x").mapInArrow(run, "s array<double>").select(F.posexplode("s").alias("k", "v")).groupBy("k").agg(F.sum("v").alias("v")).orderBy("k")
        s = np.array([r["v"] for r in sums.collect()])
        n, shift, product = s[0], s[1 : p + 1] / s[0], s[p + 1 :].reshape(p, p)
        new = (product - n * np.outer(shift, shift) + ridge * np.diag(variance)) / (n + ridge)
        moved = max(np.abs(shift / scale).max(), np.abs((new - cov) / np.outer(scale, scale)).max())
        mean, cov = mean + shift, (new + new.T) / 2
        if moved <= within:
            return mean, cov, t
    raise ValueError(f"the law still moves by {moved} after {rounds} rounds")


def chained_fill(cells: DataFrame, features: list, ridge: float = 1.0, rounds: int = 200, within: float = 1e-4) -> DataFrame:
    """(entity, feature, value, filled): every feature of every entity that has an observed cell; missing ones as all its observed features let expect them (`fitted_law`)."""
    p = len(features)
    rows = stored(rows_of(cells, features), "gaps")
    mean, cov, _ = fitted_law(rows, p, ridge, rounds, within)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = values_of(b.column("x"), p)
            out = x.copy()
            for some, full, _ in _expected(x, mean, cov) if len(b) else ():
                out[some] = full
            ends = pa.array(np.arange(len(b) + 1, dtype=np.int32) * p)
            yield pa.RecordBatch.from_arrays([b.column("entity"), b.column("x"), pa.ListArray.from_arrays(ends, pa.array(out.ravel()))], ["entity", "x", "full"])

    full = rows.select("entity", "x").mapInArrow(run, f"entity {rows.schema['entity'].dataType.simpleString()}, x array<double>, full array<double>")
    names = F.array(*map(F.lit, features))
    each = full.select("entity", F.posexplode(F.arrays_zip("x", "full")).alias("k", "c"))
    return each.select("entity", F.get(names, F.col("k")).alias("feature"), F.col("c.full").alias("value"), F.col("c.x").isNull().alias("filled"))


def boosted(train: DataFrame, test: DataFrame, x: list[str], y: str, trees: int = 20, depth: int = 4, step: float = 0.2, seed: int = 1) -> DataFrame:
    """`test` with `p`, predicted by gradient-boosted trees of the training rows. Spark's own learner sums gradients by node, feature and bin, a level of a tree at a time.

    Rows of equal predictors always share a leaf, and a split's gain depends on weights and sums only, so they are one row with their mean and their number as
    its weight: rounds over all levels of all trees read distinct predictors, not rows. Rows without a y are left out.
    """
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import GBTRegressor

    together = VectorAssembler(inputCols=x, outputCol="_x", handleInvalid="skip")
    known = train.where(F.col(y).isNotNull()).groupBy(*x).agg(F.avg(y).alias("_y"), F.count(F.lit(1)).cast("double").alias("_w"))
    distinct = stored(known, "boosted-rows")
    model = GBTRegressor(featuresCol="_x", labelCol="_y", weightCol="_w", predictionCol="p", maxIter=trees, maxDepth=depth, stepSize=step, seed=seed).fit(together.transform(distinct))
    return model.transform(together.transform(test)).drop("_x")
