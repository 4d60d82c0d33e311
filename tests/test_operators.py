"""Operators against NumPy, plain loops and identities."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from matrixloom.operators import cells as C
from matrixloom.operators import contracts
from matrixloom.operators import geometry as G
from matrixloom.operators import ranks as W
from matrixloom.operators import regress as D
from matrixloom.operators import resample as B
from matrixloom.operators import surfaces as M

RNG = np.random.default_rng(44)
X = RNG.normal(size=(90, 7))


def as_cells(spark, x):
    rows = [(i, j, None if np.isnan(v) else float(v)) for (i, j), v in np.ndenumerate(x)]
    return spark.createDataFrame(rows, "entity long, feature int, value double")


def as_matrix(cells, shape):
    out = np.full(shape, np.nan)
    for r in cells.collect():
        out[r["entity"], r["feature"]] = np.nan if r["value"] is None else r["value"]
    return out


def test_centring_identities(spark):
    c = as_cells(spark, X)
    two = as_matrix(M.centred(c), X.shape)
    assert np.allclose(two, X - X.mean(1, keepdims=True) - X.mean(0) + X.mean())
    assert np.allclose(two.sum(0), 0) and np.allclose(two.sum(1), 0)
    shares = M.variance_shares(c).first()
    assert shares["ss_entity"] + shares["ss_feature"] + shares["ss_interaction"] == pytest.approx(shares["ss_total"])


def test_correlations_and_participation(spark):
    c = as_cells(spark, X)
    pairs = G.correlations(c, list(range(7)))
    m = G.matrix(pairs, 7)
    assert np.allclose(m, np.corrcoef(X, rowvar=False))
    w = np.linalg.eigvalsh(m)
    assert G.participation(pairs, 7).first()["pr"] == pytest.approx(w.sum() ** 2 / (w**2).sum())
    assert G.spectrum(m)["pr"] == pytest.approx(w.sum() ** 2 / (w**2).sum())


def test_missing_cells_are_left_out_pair_by_pair(spark):
    x = X.copy()
    x[RNG.random(x.shape) < 0.3] = np.nan
    want = pd.DataFrame(x).corr().to_numpy()
    assert np.allclose(G.matrix(G.correlations(as_cells(spark, x), list(range(7))), 7), want)
    rho = {(r["i"], r["j"]): r["rho"] for r in G.rank_correlations(as_cells(spark, x)).collect()}
    want = pd.DataFrame(x).corr("spearman")
    assert all(v == pytest.approx(want.loc[k]) for k, v in rho.items())


def test_projection_equals_centred_covariance(spark):
    c = as_cells(spark, X)
    off = G.pair_moments(G.rows_of(c, list(range(7))), 7).select("i", "j", G.covariance().alias("c"))
    own = c.groupBy("feature").agg(F.var_samp("value").alias("c")).select(F.col("feature").alias("i"), F.col("feature").alias("j"), "c")
    got = G.projected(G.mirrored(off, "c").union(own)).toPandas().pivot(index="i", columns="j", values="c").to_numpy()
    assert np.allclose(got, np.cov(X - X.mean(1, keepdims=True), rowvar=False))


def test_ties_share_ranks(spark):
    df = spark.createDataFrame([(1.0, 0), (1.0, 1), (3.0, 2), (2.0, 3)], "v double, k int")
    got = {r["k"]: r["r"] for r in df.select("k", W.average_rank([], "v").alias("r")).collect()}
    assert got == {0: 1.5, 1: 1.5, 2: 4.0, 3: 3.0}
    later = {r["k"]: r["label"] for r in W.upper_tail(df.where("k < 2"), "v", "k", 0.5).collect()}
    first = {r["k"]: r["label"] for r in W.upper_tail(df.where("k < 2"), "v", "k", 0.5, later_wins=False).collect()}
    assert later == {0: 0, 1: 1} and first == {0: 1, 1: 0}


def test_holm_bins_and_extremes(spark):
    p = spark.createDataFrame([(0.01, 0), (0.04, 1), (0.03, 2), (0.9, 3)], "p double, k int")
    got = [r["adjusted"] for r in W.holm(p, "p", "k").orderBy("k").collect()]
    assert np.allclose(got, [0.04, 0.09, 0.09, 0.9])
    v = spark.createDataFrame([(float(k),) for k in (1, 2, 4, 8, 16)], "v double")
    assert sorted(r["bin"] for r in W.quantile_bins(v, "v", 4).collect()) == [0, 0, 1, 2, 3]
    with pytest.raises(ValueError):
        W.quantile_bins(spark.createDataFrame([(1.0,)] * 5, "v double"), "v", 4)
    with pytest.raises(ValueError):
        W.extremes(spark.createDataFrame([(1.0,)] * 5, "v double"), "v", 0.25)


def test_kendall_equals_a_plain_count(spark):
    x, y = RNG.integers(0, 6, 80), RNG.integers(0, 6, 80)
    got = G.kendall(spark.createDataFrame(list(zip(x.tolist(), y.tolist())), "x int, y int"), "x", "y").first()["tau"]
    s = sum(np.sign(x[i] - x[j]) * np.sign(y[i] - y[j]) for i in range(80) for j in range(i))
    ties = lambda v: sum(n * (n - 1) / 2 for n in np.bincount(v))
    n = 80 * 79 / 2
    assert got == pytest.approx(s / np.sqrt((n - ties(x)) * (n - ties(y))))


def test_contracts_raise(spark):
    df = spark.createDataFrame([(1, 1.0), (1, 2.0), (2, float("nan"))], "k int, v double")
    for bad in (lambda: contracts.unique(df, ["k"]), lambda: contracts.finite(df, ["v"]), lambda: contracts.within(df, "v", 0, 1), lambda: contracts.shape(df, 2, 2), lambda: contracts.validated_join(df, df, ["k"])):
        with pytest.raises(contracts.ContractError):
            bad()
    one = df.where("k = 2")
    assert contracts.validated_join(one, df, ["k"], validate="one_to_many").count() == 1


def test_clip_keeps_nulls_and_fill_fills(spark):
    x = np.array([[1.0, np.nan], [-2.0, 3.0], [0.5, 5.0]])
    c = as_cells(spark, x)
    clipped = as_matrix(c.withColumn("value", C.clip_above(F.col("value"))), x.shape)
    assert np.allclose(clipped, [[0, np.nan], [-2, 0], [0, 0]], equal_nan=True)
    assert as_matrix(C.fill(c, "median"), x.shape)[0, 1] == 4.0
    assert {r["entity"] for r in C.complete_cases(c, 2).collect()} == {1, 2}
    assert {r["feature"] for r in C.drop_sparsest(c).collect()} == {0}


def test_additive_fill_recovers_an_additive_matrix(spark):
    full = np.add.outer(np.arange(6.0), [0.0, 10.0, -3.0])
    x = full.copy()
    x[0, 1] = x[4, 2] = np.nan
    assert np.allclose(as_matrix(C.additive_fill(as_cells(spark, x)), x.shape), full, atol=1e-6)


def test_fold_local_equals_a_loop_over_folds(spark):
    c = as_cells(spark, X).withColumn("fold", (F.col("entity") % 3).cast("int"))
    got = as_matrix(M.fold_local(c, "fold", 3), X.shape)
    for f in range(3):
        inside = np.arange(len(X)) % 3 == f
        rest = X[~inside]
        assert np.allclose(got[inside], (X[inside] - rest.mean(0)) / rest.std(0, ddof=1))


def test_rank_normal_is_symmetric(spark):
    got = as_matrix(M.rank_normal(as_cells(spark, X)), X.shape)
    assert np.allclose(got.mean(0), 0) and np.allclose(got.std(0), got.std(0)[0])


def test_relabelling_doesn_t_depend_on_partitions_and_finds_a_copy(spark):
    a = np.corrcoef(X, rowvar=False)
    draws = B.relabelled(spark, a, a, 60, 3)
    again = B.relabelled(spark, a, a, 60, 3).repartition(7)
    key = lambda d: sorted((r["replicate"], r["rho"]) for r in d.collect())
    assert key(draws) == key(again)
    t = B.tail(draws, "rho").first()
    assert t["observed"] == pytest.approx(1) and t["p_upper"] <= 0.1 and t["draws"] == 60
    assert B.exact_tail(B.enumerated(spark, a, a)).first()["p"] == pytest.approx(1 / 5040)
    fixed = B.relabelled(spark, a, a, 10, 3, blocks=list(range(7)))
    assert all(r["rho"] == pytest.approx(1) for r in fixed.collect())


def test_nulls_keep_their_invariants(spark):
    m = RNG.random((12, 15)) < 0.4
    s = B.swapped(m, 1, 400)
    assert (s.sum(0) == m.sum(0)).all() and (s.sum(1) == m.sum(1)).all() and (s != m).any()
    for kind in ("columns", "gaussian", "rows"):
        r = {x["replicate"]: x["pr"] for x in B.null_ratios(spark, X, 5, 2, kind).collect()}
        assert len(r) == 6 and all(1 <= v <= 7 for v in r.values())


def test_jackknife_and_bootstrap(spark):
    pairs = G.correlations(as_cells(spark, X), list(range(7)))
    got = {r["dropped"]: r["pr"] for r in B.without_each(pairs, 7).collect()}
    for k in range(7):
        w = np.linalg.eigvalsh(np.corrcoef(np.delete(X, k, 1), rowvar=False))
        assert got[k] == pytest.approx(w.sum() ** 2 / (w**2).sum())
    j = B.jackknife(B.without_each(pairs, 7), "pr").first()
    v = np.array(list(got.values()))
    assert j["se"] == pytest.approx(np.sqrt(6 / 7 * ((v - v.mean()) ** 2).sum()))
    df = as_cells(spark, X)
    i = B.interval(B.bootstrap_means(df, "entity", "value", 200, 5), "mean").first()
    assert i["low"] < X.mean() < i["high"]


def test_splits(spark):
    df = spark.createDataFrame([(k, 1 + k % 4) for k in range(50)], "g long, n long")
    load = B.lightest_blocks(df, "g", "n", 5).groupBy("block").agg(F.sum("n").alias("s")).collect()
    assert len(load) == 5 and max(r["s"] for r in load) - min(r["s"] for r in load) <= 4
    s = B.disjoint_supports(df, "g", 1, 10, 3).groupBy("support").count().collect()
    assert sorted(r["count"] for r in s) == [10, 10, 10]


def test_models_from_sums_equal_least_squares(spark):
    y = X[:, :2] @ [[1.0, 2.0], [0.5, -1.0]] + 0.1 * RNG.normal(size=(90, 2))
    df = spark.createDataFrame([(int(k % 3), *map(float, X[k, :2]), *map(float, y[k])) for k in range(90)], "fold int, a double, b double, u double, v double")
    got = D.held_out(df, ["a", "b"], ["u", "v"], "fold").toPandas()
    for f in range(3):
        t, h = got[got.fold != f], got[got.fold == f]
        beta = np.linalg.lstsq(np.column_stack([np.ones(len(t)), t[["a", "b"]]]), t[["u", "v"]], rcond=None)[0]
        assert np.allclose(np.column_stack([np.ones(len(h)), h[["a", "b"]]]) @ beta, h[["p_u", "p_v"]])
    assert D.out_of_fold_r2(D.held_out(df, ["a", "b"], ["u", "v"], "fold"), "u", "p_u").first()["r2"] > 0.9


def test_driver_algebra():
    a = np.corrcoef(X, rowvar=False)
    assert np.allclose(G.kernel(a, 7), a)
    assert np.allclose(G.subspace_cosines(a, a, 3), 1)
    assert sorted(G.leaf_order(a)) == list(range(7))
    assert len(set(G.pivot_features(a, 4, 4))) == 4
    assert len(set(G.farthest_order(1 - a, 5))) == 5
    v, cosine = G.leading_axis(np.full((3, 3), 0.5) + 0.5 * np.eye(3))
    assert cosine == pytest.approx(1) and np.allclose(v, v[0])


def test_ranks_and_numbers_without_a_task_for_all(spark):
    import hashlib

    rng = np.random.default_rng(6)
    rows = [(int(g), float(v)) for g, v in zip(rng.integers(0, 3, 900), np.round(rng.normal(size=900), 2))] + [(0, None)]
    df = spark.createDataFrame(rows, "g int, v double")
    for by in ([], ["g"]):
        got = {tuple(r[c] for c in by) + (r["v"],): r["rank"] for r in W.value_ranks(df, "v", by).collect()}
        for g in range(3) if by else [None]:
            some = [v for k, v in rows if v is not None and g in (None, k)]
            for v in set(some):
                at = (g, v) if by else (v,)
                assert got[at] == sum(x < v for x in some) + (some.count(v) + 1) / 2
    keys = spark.range(500).selectExpr("id", "id % 2 AS g", "sha2(cast(id AS string), 256) AS h")
    for r in W.numbered(keys, ["g"], "h").groupBy("g").agg({"k": "max"}).collect():
        assert r[1] == 249
    order = sorted(range(0, 500, 2), key=lambda k: hashlib.sha256(str(k).encode()).hexdigest())
    assert [r["id"] for r in W.numbered(keys, ["g"], "h").where("g = 0").orderBy("k").collect()] == order
