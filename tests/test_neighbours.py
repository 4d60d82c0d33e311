"""Nearest rows from cells against all distances."""

from __future__ import annotations

import numpy as np
import pytest

from matrixloom.operators import neighbours as K

RNG = np.random.default_rng(12)


def plain(x, anchors, k):
    z = np.zeros_like(x)
    for j in range(x.shape[1]):
        s = x[:, j].std(ddof=1)
        z[:, j] = (x[:, j] - x[:, j].mean()) / s if s else 0.0
    out = []
    for a in anchors:
        gaps = sorted((round(float(((z[a] - z[b]) ** 2).sum()), 9), b) for b in range(len(x)) if b != a)
        out += [(a, b, r + 1) for r, (_, b) in enumerate(gaps[:k])]
    return sorted(out)


def rows_of(spark, x, extra=()):
    names = [f"f{j}" for j in range(x.shape[1])]
    return names, spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(x)] + list(extra), "k int, " + ", ".join(f"{n} double" for n in names)).repartition(4)


@pytest.mark.parametrize(("features", "kind"), [(1, "normal"), (2, "normal"), (3, "normal"), (2, "crowd"), (2, "heavy"), (2, "flat")])
def test_nearest_equal_all_distances(spark, features, kind):
    x = np.round(RNG.normal(size=(400, features)), 2)
    if kind == "crowd":
        x[:150] = x[0]  # more than a third are one point
    if kind == "heavy":
        x = np.round(np.exp(4 * x), 3)
    if kind == "flat":
        x[:, 1] = 3.0
    names, df = rows_of(spark, x)
    got = K.nearest(df, "k", names, df.where("k % 7 = 0"), 5)
    assert sorted(tuple(r) for r in got.collect()) == plain(x, range(0, 400, 7), 5)


def test_few_rows_nulls_and_outside_anchors(spark):
    x = np.array([[0.0, 0.0], [1.0, 0.0], [5.0, 5.0]])
    names, df = rows_of(spark, x, [(None, 1.0, 1.0), (9, None, 2.0)])
    assert sorted(tuple(r) for r in K.nearest(df, "k", names, df, 5).collect()) == plain(x, range(3), 5)
    far = spark.createDataFrame([(100, 1000.0, -1000.0)], "k int, f0 double, f1 double")
    assert [r["neighbour"] for r in K.nearest(df, "k", names, far, 2).orderBy("rank").collect()] == [1, 2]
    assert K.nearest(df.limit(0), "k", names, far, 2).isEmpty()


def test_cells_compare_few_pairs(spark):
    n = 20000
    names, df = rows_of(spark, RNG.normal(size=(n, 2)))
    rows, asked = df.selectExpr("k AS neighbour", "f0 AS _z0", "f1 AS _z1"), df.where("k % 100 = 0").selectExpr("k AS anchor", "f0 AS _a0", "f1 AS _a1")
    assert K.met(rows, asked, 2, 8 / (n / K.HELD) ** 0.5).count() < n * n / 100 / 100
