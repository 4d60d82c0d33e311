"""Quantiles, ranks and Kendall's tau from ranges of values, against pandas and plain counts."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from matrixloom.operators import aggregates as A
from matrixloom.operators import geometry as G
from matrixloom.operators import ranks as W

RNG = np.random.default_rng(3)


@pytest.fixture(scope="module")
def rows(spark):
    """Three groups of unlike size and range; one value holds a third of the rows, some are null."""
    n = 3000
    g = RNG.choice(["a", "b", "c"], n, p=[0.8, 0.15, 0.05])
    v = np.where(RNG.random(n) < 1 / 3, 7.0, np.round(RNG.normal(0, 50, n), 1) + (g == "c") * 1000)
    w = np.round(v + RNG.normal(0, 40, n), 0)
    p = pd.DataFrame({"g": g, "v": np.where(RNG.random(n) < 0.02, np.nan, v), "w": w})
    return p, spark.createDataFrame([(x.g, None if np.isnan(x.v) else x.v, x.w) for x in p.itertuples()], "g string, v double, w double")


def test_quantiles(rows):
    p, df = rows
    shares = {"low": 0.025, "mid": 0.5, "high": 0.9, "least": 0.0, "most": 1.0}
    got = {r["g"]: r for r in W.quantiles(df, "v", shares, ["g"]).collect()}
    for g, x in p.dropna().groupby("g"):
        assert [got[g][k] for k in shares] == pytest.approx([x.v.quantile(q) for q in shares.values()])
    whole = W.quantiles(df, "v", {"mid": 1 / 3}).first()
    assert whole["mid"] == pytest.approx(p.v.quantile(1 / 3))


def test_ranks_and_their_correlation(rows):
    p, df = rows
    p = p.dropna()
    got = sorted((r["g"], r["v"], r["w"], r["closed"]) for r in W.percentile_ranks(df, "v", ["g"]).collect())
    p = p.assign(r=p.groupby("g").v.rank(), n=p.groupby("g").v.transform("count"))
    want = sorted(zip(p.g, p.v, p.w, (p.r - 1) / (p.n - 1)))
    assert [x[:3] for x in got] == [x[:3] for x in want] and np.allclose([x[3] for x in got], [x[3] for x in want])
    rho = {r["g"]: r["rho"] for r in G.row_spearman(df, "v", "w", ["g"]).collect()}
    assert rho == pytest.approx({g: x.v.rank().corr(x.w.rank()) for g, x in p.groupby("g")})


def test_kendall_over_many_ranges(rows):
    p, df = rows
    p = p.dropna()
    v, w = p.v.to_numpy(), p.w.to_numpy()
    s = sum(float((np.sign(v[i] - v[:i]) * np.sign(w[i] - w[:i])).sum()) for i in range(len(v)))
    ties = lambda x: sum(c * (c - 1) / 2 for c in np.unique(x, return_counts=True)[1])
    n = len(v) * (len(v) - 1) / 2
    assert G.kendall(df, "v", "w").first()["tau"] == pytest.approx(s / np.sqrt((n - ties(v)) * (n - ties(w))))


def test_median_deviation(rows):
    p, df = rows
    got = {r["g"]: (r["median"], r["scale"]) for r in A.mad_scale(df, ["g"], "v").collect()}
    for g, x in p.dropna().groupby("g"):
        away = (x.v - x.v.median()).abs().median()
        assert got[g] == pytest.approx((x.v.median(), away * 1.4826 if away else 1.0))


def test_empty_and_constant_tables(spark):
    empty = spark.createDataFrame([], "g string, v double, w double")
    assert W.quantiles(empty, "v", {"mid": 0.5}, ["g"]).isEmpty() and W.value_ranks(empty, "v").isEmpty() and G.row_spearman(empty, "v", "w", ["g"]).isEmpty()
    one = spark.createDataFrame([("a", 2.0, 1.0)] * 4 + [("b", None, 1.0)], "g string, v double, w double")
    assert [tuple(r) for r in W.quantiles(one, "v", {"mid": 0.5}, ["g"]).collect()] == [("a", 2.0)]
    assert {r["rank"] for r in W.value_ranks(one, "v").collect()} == {2.5}


def test_running_sums_and_holm_over_ranges(spark):
    """Ties, groups of unlike size and a value that a third of the rows have, dealt to many ranges."""
    rng = np.random.default_rng(8)
    n = 600
    p = pd.DataFrame({"g": rng.choice(["a", "b"], n, p=[0.9, 0.1]), "v": np.where(rng.random(n) < 1 / 3, 0.5, np.round(rng.random(n), 2)), "k": np.arange(n)})
    df = spark.createDataFrame(p).repartition(7)
    order = [F.col("v").desc(), F.col("k").asc()]
    rows = W.ranged(df, ["g"], order, 9)
    assert rows.select("_part").distinct().count() > 1
    got = W.carried(W.carried(rows, ["g"], order, "place", F.lit(1)), ["g"], order, "top", F.col("k"), F.max).toPandas().sort_values("k")
    s = p.sort_values(["g", "v", "k"], ascending=[True, False, True])
    s["place"], s["top"] = s.groupby("g").cumcount() + 1, s.groupby("g")["k"].cummax()
    assert got[["place", "top"]].to_numpy().tolist() == s.sort_values("k")[["place", "top"]].to_numpy().tolist()
    held = W.holm(df, "v", "k").toPandas().sort_values(["v", "k"])
    assert held["adjusted"].tolist() == np.maximum.accumulate(np.minimum(1.0, held["v"] * (n - np.arange(n)))).tolist()
    assert W.holm(df.limit(0), "v", "k").isEmpty()
