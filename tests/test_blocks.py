"""Blocks, bases, components, refits and random subspaces against plain forms."""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pandas as pd
import pytest

from matrixloom.operators import cells as C
from matrixloom.operators import regress as D
from matrixloom.operators import resample as B
from matrixloom.operators import retrieval as T
from matrixloom.plans.base import BRANDS
from matrixloom.plans.blocks import _parts
from matrixloom.plans.registry import QUERIES

DATA = "/root/testdata/sf0.01"
RNG = np.random.default_rng(12)
UP = np.triu_indices(8, 1)


def symmetric(p):
    x = RNG.normal(size=(p, p))
    return x + x.T


def test_blocks_are_all_sets_of_a_row(spark):
    held = {1: "bdac", 2: "ab", 3: "aceg"}
    df = spark.createDataFrame([(e, f, float(ord(f) + e)) for e, fs in held.items() for f in fs], "entity int, feature string, v double")
    got = sorted((r["block"], [x["v"] for x in r["x"]]) for r in C.blocks(df, 3, ["v"]).collect())
    want = sorted((" ".join(s), [float(ord(f) + e) for f in s]) for e, fs in held.items() for s in combinations(sorted(fs), 3))
    assert got == want
    assert C.blocks(df.limit(0), 3, ["v"]).isEmpty()


def test_bases_equal_fits_of_rows(spark):
    n = 300
    p = pd.DataFrame(RNG.normal(size=(n, 3)), columns=["a", "b", "c"]).assign(fold=RNG.integers(0, 4, n))
    p["y"] = 3 + p.a - 2 * p.c + RNG.normal(size=n)
    got = D.bases_r2(spark.createDataFrame(p), {"ab": ["a", "b"], "ca": ["c", "a"]}, "y", "fold")
    for basis, names in {"ab": ["a", "b"], "ca": ["c", "a"]}.items():
        z, e = np.column_stack([np.ones(n), p[names]]), np.zeros(n)
        for f in range(4):
            own = (p.fold == f).to_numpy()
            e[own] = p.y[own] - z[own] @ np.linalg.lstsq(z[~own], p.y[~own], rcond=None)[0]
        assert got[basis] == pytest.approx(1 - (e**2).sum() / ((p.y - p.y.mean()) ** 2).sum())


def test_components_add_up_in_the_first_mode(spark):
    c = _parts(spark, DATA).toPandas()
    wide = {k: c.pivot(index="entity", columns="feature", values=k)[BRANDS].dropna() for k in ("total", "net", "cut")}
    z = wide["total"] / wide["total"].std()
    axis = np.linalg.eigh(np.corrcoef(z.to_numpy(), rowvar=False))[1][:, -1]
    t = z.to_numpy() @ axis
    got = QUERIES["g23_mode_shares"](spark, DATA).first()
    for k in ("net", "cut"):
        assert got[k] == pytest.approx(np.cov((wide[k] / wide["total"].std()).to_numpy() @ axis, t)[0, 1] / t.var(ddof=1))
    assert got["net"] + got["cut"] == pytest.approx(1)


def test_random_axes_keep_eigenvalues(spark):
    c = np.corrcoef(RNG.normal(size=(40, 8)) @ RNG.normal(size=(8, 8)), rowvar=False)
    w, v = np.linalg.eigh(c)
    k = (v[:, -2:] * w[-2:]) @ v[:, -2:].T
    d = np.sqrt(np.diag(k))
    label = T.strongest((k / np.outer(d, d))[UP], 0.2)
    draws = B.matched_subspaces(spark, c, 2, label, 60, 5).toPandas().set_index("replicate")["auc"]
    assert len(draws) == 61 and draws[0] == 1.0 and draws[1:].max() < 1 and abs(draws[1:].mean() - 0.5) < 0.15
    assert B.matched_subspaces(spark, c, 2, label, 60, 5).toPandas().set_index("replicate")["auc"].equals(draws)


def test_refits_find_what_a_candidate_adds(spark):
    x, prior = symmetric(8), symmetric(8)
    y = prior + 2 * x
    shares, gates = [0.2, 0.3], [0.0, 0.5]
    draws = B.refit_relabelled(spark, y, x, prior, 40, 6, shares, gates).toPandas().set_index("replicate")["gain"]

    def auc(z):
        fit = z @ np.linalg.lstsq(z, y[UP], rcond=None)[0]
        return np.mean([T.pair_auc(fit, T.strongest(y[UP], s)) for s in shares])

    one = np.ones(len(UP[0]))
    cut = np.where(x[UP] >= np.quantile(x[UP], 0.5), x[UP], 0)
    want = max(auc(np.column_stack([one, prior[UP], g])) for g in (x[UP], cut)) - auc(np.column_stack([one, prior[UP]]))
    assert draws[0] == pytest.approx(want) and draws[0] >= draws[1:].max() - 1e-12
