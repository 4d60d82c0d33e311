"""Centred moments far from zero, with gaps, weights and many parts, against exact and high-precision arithmetic."""

from __future__ import annotations

from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from matrixloom.operators import aggregates as A
from matrixloom.operators import geometry as G
from matrixloom.operators import moments as S
from matrixloom.operators import regress as D
from matrixloom.operators import resample as B
from matrixloom.operators import surfaces as M

RNG = np.random.default_rng(77)
N, P = 2000, 4


def base():
    z = RNG.normal(size=(N, P))
    z[:, 1] += z[:, 0]
    return np.round(z * 1024) / 1024  # dyadic, so that adding a large mean loses nothing


def exact(x, w=None):
    """Correlation of two columns in rationals over rows that have both."""
    w = np.ones(len(x)) if w is None else w
    rows = [(Fraction(float(a)), Fraction(float(b)), Fraction(float(c))) for (a, b), c in zip(x, w) if not (np.isnan(a) or np.isnan(b))]
    n = sum(c for _, _, c in rows)
    mx, my = sum(a * c for a, _, c in rows) / n, sum(b * c for _, b, c in rows) / n
    cxx, cyy = sum(c * (a - mx) ** 2 for a, _, c in rows), sum(c * (b - my) ** 2 for _, b, c in rows)
    cxy = sum(c * (a - mx) * (b - my) for a, b, c in rows)
    return float(cxy) / (float(cxx) * float(cyy)) ** 0.5, float(cxy)


def as_rows(spark, x, w=None, parts=5):
    w = np.ones(len(x)) if w is None else w
    rows = [(k, [None if np.isnan(v) else float(v) for v in r], float(c), k % 3) for k, (r, c) in enumerate(zip(x, w))]
    return spark.createDataFrame(rows, "entity long, x array<double>, w double, g int").repartition(parts)


@pytest.mark.parametrize("mean", [0.0, 1e6, 1e9])
@pytest.mark.parametrize("gaps", [False, True])
@pytest.mark.parametrize("weighted", [False, True])
def test_pair_moments_far_from_zero(spark, mean, gaps, weighted):
    x = base()[:600] + mean * np.array([1, -1, 1, 0.5])
    if gaps:
        x[RNG.random(x.shape) < 0.3] = np.nan
        x[:150, 2] = np.nan  # whole tasks without a value
    w = RNG.integers(0, 4, len(x)).astype(float) if weighted else None
    for r in G.pair_moments(as_rows(spark, x, w), P, weight="w" if weighted else None).withColumn("r", S.correlation()).collect():
        want, cxy = exact(x[:, [r["i"], r["j"]]], w)
        assert r["r"] == pytest.approx(want, rel=1e-8, abs=1e-10) and r["cxy"] == pytest.approx(cxy, rel=1e-8, abs=1e-6)


def test_groups_and_bootstrap_far_from_zero(spark):
    x = base() + 1e9
    got = {(r["g"], r["i"], r["j"]): r["r"] for r in G.pair_moments(as_rows(spark, x), P, ["g"]).withColumn("r", S.correlation()).collect()}
    assert len(got) == 18
    for (g, i, j), r in got.items():
        assert r == pytest.approx(exact(x[np.arange(N) % 3 == g][:, [i, j]])[0], rel=1e-8, abs=1e-10)
    near = {r["replicate"]: r["pr"] for r in B.row_bootstrap(as_rows(spark, x), P, 5, 3).collect()}
    zero = {r["replicate"]: r["pr"] for r in B.row_bootstrap(as_rows(spark, x - 1e9), P, 5, 3).collect()}
    assert near == {k: pytest.approx(v, rel=1e-8) for k, v in zero.items()}


def test_no_spread_is_null_at_any_mean(spark):
    for mean in (0.0, 1e9, -1e-9):
        x = np.column_stack([np.full(300, mean), RNG.normal(size=300), np.full(300, mean) + 0.1])
        r = {(m["i"], m["j"]): m["r"] for m in G.pair_moments(as_rows(spark, x), 3).withColumn("r", S.correlation()).collect()}
        assert r == {(0, 1): None, (0, 2): None, (1, 2): None}
    tiny = G.pair_moments(as_rows(spark, base() * 1e-9), P).withColumn("r", S.correlation())
    assert tiny.where("r IS NULL").isEmpty()


def test_merging_by_origin_equals_merging_by_window(spark):
    x = base()[:, :2] + 1e8
    parts = []
    for k in range(40):
        one = S.batch_state(x[k * 50 : (k + 1) * 50])
        parts.append((k % 2, *(float(one[c][0, 1]) for c in range(8))))
    df = spark.createDataFrame(parts, "k int, n double, mx double, my double, lx double, ly double, cxx double, cyy double, cxy double")
    a = {r["k"]: r for r in S.merged(df, ["k"]).collect()}
    b = {r["k"]: r for r in S.merged(df.withColumns({"u": F.lit(1e8 + 1), "v": F.lit(1e8 - 1)}), ["k"], ("u", "v")).collect()}
    for k in (0, 1):
        for c in S.STATE:
            assert a[k][c] == pytest.approx(b[k][c], rel=1e-9, abs=1e-8)


def test_weighted_correlation_far_from_zero(spark):
    x, w = base()[:500, :2] + 1e9, RNG.integers(1, 5, 500).astype(float)
    df = spark.createDataFrame([(float(a), float(b), float(c)) for (a, b), c in zip(x, w)], "a double, b double, w double")
    r = A.weighted_correlation(df, "a", "b", "w").first()
    want, cxy = exact(x, w)
    assert r["r"] == pytest.approx(want, rel=1e-8)
    assert r["cov"] == pytest.approx(cxy / w.sum() / (1 - (w**2).sum() / w.sum() ** 2), rel=1e-8)


def test_fold_local_far_from_zero(spark):
    x = base()[:300] + 1e9
    cells = spark.createDataFrame([(i, j, float(v), i % 3) for (i, j), v in np.ndenumerate(x)], "entity int, feature int, value double, fold int")
    got = np.full(x.shape, np.nan)
    for r in M.fold_local(cells, "fold", 3).collect():
        got[r["entity"], r["feature"]] = r["value"]
    z = x - 1e9
    for f in range(3):
        inside = np.arange(300) % 3 == f
        rest = z[~inside]
        assert np.allclose(got[inside], (z[inside] - rest.mean(0)) / rest.std(0, ddof=1), atol=1e-6)


def test_models_far_from_zero(spark):
    x = base()[:400]
    y = 2 * x[:, 0] - x[:, 1] + 0.1 * x[:, 2]
    rows = [(int(k % 4), *map(float, x[k, :2] + 1e8), float(y[k] + 1e8)) for k in range(400)]
    df = spark.createDataFrame(rows, "fold int, a double, b double, y double").repartition(3)
    b = D.solve(D.normal_moments(df, ["a", "b"], ["y"])[0], 2)[1:, 0]
    want = np.linalg.lstsq(np.column_stack([np.ones(400), x[:, :2]]), y, rcond=None)[0][1:]
    assert np.allclose(b, want, rtol=1e-6)
    assert D.bases_r2(df, {"both": ["a", "b"]}, "y", "fold")["both"] == pytest.approx(D.out_of_fold_r2(D.held_out(df, ["a", "b"], ["y"], "fold"), "y", "p_y").first()["r2"], abs=1e-6)
