"""Every relabelling within blocks, blocks of features, and ranks within pairs, against plain loops."""

from __future__ import annotations

from itertools import combinations, permutations, product

import numpy as np
import pandas as pd
import pytest

from matrixloom.operators import dense_blocks as X
from matrixloom.operators import geometry as G
from matrixloom.operators import resample as B

RNG = np.random.default_rng(31)


def plain_orders(blocks):
    groups = [[k for k, b in enumerate(blocks) if b == g] for g in dict.fromkeys(blocks)]
    for parts in product(*[permutations(g) for g in groups]):
        order = list(range(len(blocks)))
        for g, moved in zip(groups, parts):
            for at, k in zip(g, moved):
                order[at] = k
        yield tuple(order)


@pytest.mark.parametrize("blocks", [[0, 0, 0], [0, 1, 0, 1, 1, 2], [3], [0, 1, 2], [5, 5, 5, 5, 2]])
def test_numbers_give_every_order_once(blocks):
    n = B.orders_within(blocks)
    got = [tuple(o) for o in B.unranked(np.arange(n), blocks).tolist()]
    assert got[0] == tuple(range(len(blocks))) and sorted(got) == sorted(plain_orders(blocks)) and len(set(got)) == n


def test_exact_share_equals_a_plain_count(spark):
    a, b = (np.corrcoef(RNG.normal(size=(30, 6)), rowvar=False) for _ in range(2))
    blocks = [0, 0, 0, 1, 1, 2]
    rank = lambda m: pd.Series(m[np.triu_indices(6, 1)]).rank()
    rho = [rank(a).corr(rank(b[np.ix_(o, o)])) for o in plain_orders(blocks)]
    seen = rank(a).corr(rank(b))
    got = B.exact_tail(B.enumerated(spark, a, b, blocks)).first()
    assert got["orders"] == 12 and got["observed"] == pytest.approx(seen) and got["p"] == pytest.approx(np.mean(np.array(rho) >= seen - 1e-12))
    with pytest.raises(ValueError):
        B.enumerated(spark, np.eye(9), np.eye(9))


@pytest.mark.parametrize("mean", [0.0, 1e8])
def test_blocks_equal_a_loop_over_sets(spark, mean):
    x, y = (np.round(RNG.normal(size=(60, 6)) * 64) / 64 + mean for _ in range(2))
    gone = RNG.random(x.shape) < 0.3
    x[gone] = y[gone] = np.nan
    rows = [(k, [None if np.isnan(v) else float(v) for v in u], [None if np.isnan(v) else float(v) for v in w]) for k, (u, w) in enumerate(zip(x, y))]
    df = spark.createDataFrame([*rows, (99, [None] * 6, [None] * 6)], "entity int, u array<double>, w array<double>").repartition(3)
    m = X.block_moments(df, ["u", "w"], 6, 3).select("block", "n", *[X.block_correlation(k, 2, 3, a, b).alias(f"r{k}{a}{b}") for k in (0, 1) for a, b in combinations(range(3), 2)])
    got = {tuple(r["block"]): r for r in m.collect()}
    for s in combinations(range(6), 3):
        full = ~np.isnan(x[:, s]).any(1)
        assert full.sum() == (got[s]["n"] if s in got else 0)
        for k, v in enumerate((x, y)):
            c = np.corrcoef(v[full][:, s] - mean, rowvar=False)
            for a, b in combinations(range(3), 2):
                assert got[s][f"r{k}{a}{b}"] == pytest.approx(c[a, b], abs=1e-7)


def test_blocks_as_products_equal_enumerated_sets(spark, monkeypatch):
    """Products never deal a set of features to its blocks; tables that are too large for them still do."""
    x = RNG.normal(size=(90, 7))
    x[RNG.random(x.shape) < 0.3] = np.nan
    df = spark.createDataFrame([([None if np.isnan(v) else float(v) for v in u],) * 2 for u in x], "u array<double>, w array<double>").repartition(3)
    got = lambda size: {tuple(r["block"]): (r["n"], *r["s"], *r["q"]) for r in X.block_moments(df, ["u", "w"], 7, size).collect()}
    with monkeypatch.context() as m:
        m.setattr(X, "PRODUCTS", 0)
        want = {size: got(size) for size in (1, 2, 3, 5)}
    assert got(1) == want[1]
    monkeypatch.setattr(X, "_by_features", lambda *_: pytest.fail("sets are enumerated"))
    for size in (2, 3, 5):
        here = got(size)
        assert here.keys() == want[size].keys()
        assert all(here[b] == pytest.approx(want[size][b], abs=1e-9) for b in here)
    assert X.block_moments(df.limit(0), ["u", "w"], 7, 3).isEmpty()


def test_ranks_within_pairs_equal_a_loop(spark):
    """A value that a third of the entities have, missing cells, an entity with one cell, and a feature without cells."""
    x = np.round(RNG.normal(size=(150, 5)), 1)
    x[:50, 1] = 0.5
    x[RNG.random(x.shape) < 0.35] = np.nan
    x[0] = [1.0, *[np.nan] * 4]
    cells = spark.createDataFrame([(int(i), f"f{j}", float(x[i, j])) for i, j in np.argwhere(~np.isnan(x))] + [(0, "f1", None)], "entity int, feature string, value double").repartition(5)
    names = [f"f{j}" for j in range(5)] + ["empty"]
    for r in G.pair_ranks(cells, names).collect():
        for j in range(5):
            both = ~np.isnan(x[:, r["i"]]) & ~np.isnan(x[:, j])
            want = pd.Series(x[both, r["i"]], index=np.flatnonzero(both)).rank()
            assert r["r"][j] == (want[r["entity"]] if both[r["entity"]] else None)
        assert r["r"][5] is None
    want = pd.DataFrame(x, columns=names[:5]).corr("spearman", min_periods=10)
    got = G.rank_correlations(cells, 10, names).collect()
    assert len(got) == 10 and all(r["rho"] == pytest.approx(want.loc[r["i"], r["j"]]) for r in got)
    assert G.rank_correlations(cells.limit(0), 1).isEmpty()
