"""Relabelled endpoints and cumulated modes against plain forms."""

import numpy as np
import pandas as pd
import pytest

from matrixloom.operators import resample as B
from matrixloom.operators import retrieval as T
from matrixloom.plans.inference import _two
from matrixloom.plans.registry import QUERIES
from matrixloom.plans.sensitivity import _halves

DATA = "/root/testdata/sf0.001"
RNG = np.random.default_rng(8)
UP = np.triu_indices(25, 1)


def symmetric(p):
    x = RNG.normal(size=(p, p))
    return x + x.T


def plain_auc(score, label):
    one, zero = score[label == 1], score[label == 0]
    return np.mean([(a > b) + 0.5 * (a == b) for a in one for b in zero])


def test_area_of_pairs_with_ties():
    score, label = RNG.integers(0, 5, 60).astype(float), T.strongest(RNG.normal(size=60), 0.2)
    assert label.sum() == 12
    assert T.pair_auc(score, label) == pytest.approx(plain_auc(score, label))
    assert T.strongest(np.array([1.0, 2.0, 2.0]), 0.1).tolist() == [0, 1, 0]


def test_all_modes_are_the_matrix(spark):
    a, b = _two(spark, DATA)
    rows = QUERIES["t08_cumulative_modes"](spark, DATA).toPandas().set_index("modes")["auc"]
    label = T.strongest(b[UP], 0.2)
    assert sorted(rows.index) == list(range(1, 26))
    assert rows[25] == pytest.approx(plain_auc(np.round(a[UP], 12), label), abs=2e-3)
    w, v = np.linalg.eigh(a)
    assert rows[1] == pytest.approx(plain_auc((w[-1] * np.outer(v[:, -1], v[:, -1]))[UP], label))


def test_relabelled_retrieval_and_changes(spark):
    a, b = _two(spark, DATA)
    row = QUERIES["n24_relabelled_retrieval"](spark, DATA).first()
    assert row["draws"] == 200 and row["observed"] == pytest.approx(plain_auc(a[UP], T.strongest(b[UP], 0.2)))
    row = QUERIES["n03_changes_relabelled"](spark, DATA).first()
    one, two = (pd.Series(_halves(spark, DATA, c)[UP]) for c in ("value", "score"))
    assert row["draws"] == 100 and row["observed"] == pytest.approx(one.rank().corr(two.rank()))


def test_both_semi_partial_forms_start_from_one_t(spark):
    x, z = symmetric(12), symmetric(12)
    y = 2 * x - z + 0.3 * symmetric(12)
    draws = B.semi_partialled(spark, y, x, z, 60, 5).toPandas().set_index("replicate")
    up = np.triu_indices(12, 1)
    design = np.column_stack([np.ones(66), x[up], z[up]])
    b, rss = np.linalg.lstsq(design, y[up], rcond=None)[:2]
    t = b[1] / np.sqrt(rss[0] / 63 * np.linalg.inv(design.T @ design)[1, 1])
    assert draws.loc[0, "response"] == pytest.approx(t) and draws.loc[0, "predictor"] == pytest.approx(t)
    assert (draws.loc[1:].abs() < t).all().all()
    noise = B.semi_partialled(spark, symmetric(12), x, z, 60, 6).toPandas().set_index("replicate").loc[1:]
    assert abs(noise.to_numpy().mean()) < 1 and 0.5 < noise.to_numpy().std() < 2
