"""Filling by conditional regressions, and threshold clusters, against dense and sequential versions."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from matrixloom.operators import cells as C
from matrixloom.operators import clusters as K
from matrixloom.operators import geometry as G
from matrixloom.operators import imputation as I

RNG = np.random.default_rng(14)


def table(spark, x):
    return spark.createDataFrame([(int(i), int(j), None if np.isnan(v) else float(v)) for (i, j), v in np.ndenumerate(x)], "entity int, feature int, value double").repartition(4)


def plain_law(x, ridge, rounds):
    """The same rounds row by row."""
    mean, var = np.nanmean(x, 0), np.nanvar(x, 0)
    cov = np.diag(var)
    for _ in range(rounds):
        full, extra = x.copy(), np.zeros(cov.shape)
        for r in full:
            m = np.isnan(r)
            if m.any():
                b = cov[np.ix_(m, ~m)] @ np.linalg.inv(cov[np.ix_(~m, ~m)]) if (~m).any() else np.zeros((m.sum(), 0))
                r[m] = mean[m] + b @ (r[~m] - mean[~m])
                extra[np.ix_(m, m)] += cov[np.ix_(m, m)] - b @ cov[np.ix_(~m, m)]
        n = len(x)
        new = full.mean(0)
        cov = (n * np.cov(full, rowvar=False, bias=True) + extra + ridge * np.diag(var)) / (n + ridge)
        mean = new
    return mean, cov


def test_law_and_fill_equal_plain_rounds_and_beat_the_mean(spark):
    factor = RNG.normal(size=(120, 2)) @ RNG.normal(size=(2, 6))
    whole = factor + 0.3 * RNG.normal(size=factor.shape) + 50
    x = whole.copy()
    x[RNG.random(x.shape) < 0.25] = np.nan
    x = x[~np.isnan(x).all(1)]
    df = table(spark, x)
    mean, cov, taken = I.fitted_law(G.rows_of(df, list(range(6))), 6, 1.0, 200, 1e-4)
    want = plain_law(x, 1.0, taken)
    assert np.allclose(mean, want[0], atol=1e-8) and np.allclose(cov, want[1], atol=1e-8)
    miss = np.isnan(x)
    error = {}
    for name, rows in (("chained", I.chained_fill(df, list(range(6)))), ("mean", C.fill(df, "mean"))):
        out = np.full(x.shape, np.nan)
        for r in rows.collect():
            out[r["entity"], r["feature"]] = r["value"]
        assert np.allclose(out[~miss], x[~miss])
        error[name] = np.sqrt(np.mean((out - whole[: len(x)])[miss] ** 2))
    assert error["chained"] < 0.6 * error["mean"]
    with pytest.raises(ValueError):
        I.fitted_law(G.rows_of(df, list(range(6))), 6, 1.0, 2, 1e-9)


def test_boosted_trees_follow_a_curve(spark):
    a = RNG.uniform(-2, 2, 600)
    df = spark.createDataFrame([(float(v), float(np.sin(2 * v))) for v in a], "a double, y double")
    out = I.boosted(df.limit(400), df, ["a"], "y").toPandas()
    assert 1 - ((out.p - out.y) ** 2).sum() / ((out.y - out.y.mean()) ** 2).sum() > 0.9


def test_boosted_trees_learn_equal_predictors_once(spark, monkeypatch):
    from pyspark.ml.regression import GBTRegressor

    rng = np.random.default_rng(9)  # no two splits gain the same
    at = rng.integers(0, 7, 840) // rng.integers(1, 3, 840), rng.integers(0, 3, 840)
    rows = [(float(a), float(b), float(a**1.7 + 3 * np.sin(2 * b + a) + e)) for a, b, e in zip(*at, rng.normal(size=840))] + [(3.0, 1.0, None)]
    df = spark.createDataFrame(rows, "a double, b double, y double")
    seen, fit = [], GBTRegressor.fit
    monkeypatch.setattr(GBTRegressor, "fit", lambda self, data, *a: seen.append(data.count()) or fit(self, data, *a))
    out = I.boosted(df, df, ["a", "b"], "y", trees=6, depth=2).toPandas()
    assert seen == [21] and len(out) == 841
    known = out.dropna()
    # the learner by itself over all rows gives the same
    from pyspark.ml.feature import VectorAssembler

    whole = VectorAssembler(inputCols=["a", "b"], outputCol="x").transform(df.dropna())
    model = GBTRegressor(featuresCol="x", labelCol="y", predictionCol="p", maxIter=6, maxDepth=2, stepSize=0.2, seed=1)
    want = fit(model, whole).transform(whole).select("a", "b", "p").distinct().toPandas().set_index(["a", "b"])["p"]
    assert np.allclose(known.groupby(["a", "b"])["p"].first(), want.loc[known.groupby(["a", "b"])["p"].first().index])


def plain_clusters(sets, percent):
    like = lambda a, b: 100 * len(a & b) >= percent * len(a | b)
    near = {k: [o for o in sets if o != k and like(sets[k], sets[o])] for k in sets}
    out = {}
    for k in sorted(sets, key=lambda k: (-len(near[k]), k)):
        if k not in out:
            out |= {o: k for o in [k, *near[k]] if o not in out}
    return out


@pytest.mark.parametrize("percent", [40, 65, 90, 100])
def test_clusters_equal_the_sequential_pass(spark, percent):
    rng = random.Random(percent)
    base = [{rng.randrange(40) for _ in range(rng.randint(2, 12))} for _ in range(12)]
    sets = {}
    for k in range(110):
        s = set(rng.choice(base))
        for _ in range(rng.randint(0, 3)):
            s ^= {rng.randrange(40)}
        if s:
            sets[k] = s
    rows = [(k, i) for k, s in sets.items() for i in s] + [(3, None), (None, 2), *[(5, i) for i in sets.get(5, ())]]
    df = spark.createDataFrame(rows, "who int, what int").repartition(4)
    got = {r["who"]: r["leader"] for r in K.threshold_clusters(df, "who", "what", percent).collect()}
    assert got == plain_clusters(sets, percent)
    assert K.threshold_clusters(df.limit(0), "who", "what", percent).isEmpty()


def test_a_hot_set_is_one_class(spark):
    """A third of all owners have the same set: they are one class of the join, and go together."""
    rows = [(k, i) for k in range(300) for i in (range(5) if k % 3 == 0 else range(k, k + 5))]
    df = spark.createDataFrame(rows, "who int, what int")
    sets = K.equal_sets(df, "who", "what")
    assert sets.where("owners = 100").count() == 1
    got = K.threshold_clusters(df, "who", "what", 60)
    assert got.where("who % 3 = 0").select("leader").distinct().count() == 1 and got.where(F.col("size") >= 100).count() >= 100


def test_blocks_of_sets_find_neighbours_and_clusters_without_pairs(spark, monkeypatch):
    """Half of all pairs of these sets share their rarest items; none becomes a row."""
    rng = random.Random(3)
    sets = {k: set(rng.sample(range(12), rng.randint(1, 9))) for k in range(150)}
    monkeypatch.setattr(K, "similar_sets", lambda *_: pytest.fail("sets are joined by items"))
    monkeypatch.setattr(K, "BLOCK", 16)
    monkeypatch.setattr(K, "ROUND", 8)
    df = spark.createDataFrame([(k, i) for k, s in sets.items() for i in s], "who int, what int")
    assert {r["who"]: r["leader"] for r in K.threshold_clusters(df, "who", "what", 65).collect()} == plain_clusters(sets, 65)


def test_many_items_are_joined(spark, monkeypatch):
    monkeypatch.setattr(K, "DENSE_ITEMS", 11)
    rng = random.Random(4)
    sets = {k: set(rng.sample(range(12), rng.randint(1, 9))) for k in range(40)}
    df = spark.createDataFrame([(k, i) for k, s in sets.items() for i in s], "who int, what int")
    assert {r["who"]: r["leader"] for r in K.threshold_clusters(df, "who", "what", 65).collect()} == plain_clusters(sets, 65)
