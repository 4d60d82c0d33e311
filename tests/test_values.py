"""Values of queries that SQL can't express, against NumPy and pandas over whole tables."""

from __future__ import annotations

import hashlib
from statistics import NormalDist

import duckdb
import numpy as np
import pandas as pd
import pytest

from matrixloom.plans.base import BRANDS, PRICED_SQL, SPARSE_SQL
from matrixloom.plans.registry import QUERIES

D = "/root/testdata/sf0.01"
UP = np.triu_indices(64, 1)


def sql(text):
    con = duckdb.connect()
    for t in ("lineitem", "part", "supplier", "embeddings", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{D}/{t}.parquet'")
    return con.execute(text).df()


@pytest.fixture(scope="module")
def x():
    e = sql("SELECT vec_id, embedding FROM embeddings ORDER BY vec_id")
    return e["vec_id"].to_numpy(), np.array(e["embedding"].tolist(), float)


@pytest.fixture(scope="module")
def c(x):
    return np.corrcoef(x[1], rowvar=False)


@pytest.fixture(scope="module")
def priced():
    return sql(f"WITH {PRICED_SQL} SELECT * FROM priced")


@pytest.fixture(scope="module")
def got(spark):
    return lambda name: QUERIES[name](spark, D).toPandas()


def corr(cells, value):
    return cells.pivot(index="entity", columns="feature", values=value)[BRANDS].corr()


def normal_scores(cells):
    r = cells.groupby("feature")["value"].rank()
    return ((r - 0.5) / cells.groupby("feature")["value"].transform("count")).map(NormalDist().inv_cdf)


def test_spectrum(got, c):
    w = np.sort(np.linalg.eigvalsh(c))[::-1]
    s = w / w.sum()
    want = {"pr": 1 / (s**2).sum(), "entropy_rank": np.exp(-(s * np.log(s)).sum()), "pc1": s[0], "modes_80": (np.cumsum(s) < 0.8).sum() + 1, "modes_90": (np.cumsum(s) < 0.9).sum() + 1}
    assert dict(got("g06_spectrum").to_numpy()) == {k: pytest.approx(v, rel=1e-7) for k, v in want.items()}


def test_leading_axis_and_truncation(got, c):
    w, v = np.linalg.eigh(c)
    axis = v[:, -1] * np.sign(v[:, -1].mean())
    g = got("g07_leading_axis").sort_values("feature")
    assert np.allclose(g["loading"], axis, atol=1e-6) and g["cosine"].iloc[0] == pytest.approx(axis.sum() / 8, abs=1e-7)
    k = sum(w[-m] * np.outer(v[:, -m], v[:, -m]) for m in range(1, 11))
    k /= np.sqrt(np.outer(np.diag(k), np.diag(k)))
    t = got("g08_truncated")
    assert len(t) == 2016 and np.allclose(t["r"], k[t["i"], t["j"]], atol=1e-6)


def test_subspaces(got, x):
    e, v = x
    a, b = (np.linalg.eigh(np.corrcoef(v[e % 2 == k], rowvar=False))[1][:, -5:] for k in (0, 1))
    assert np.allclose(got("g10_subspaces").sort_values("axis")["cosine"], np.linalg.svd(a.T @ b)[1], atol=1e-6)


def test_split_halves(got, x):
    e, v = x
    half = np.array([int(hashlib.sha256(f"3|{k}".encode()).hexdigest()[:16], 16) % 2 for k in e])
    u, w = (pd.Series(np.corrcoef(v[half == k], rowvar=False)[UP]) for k in (0, 1))
    rho = u.rank().corr(w.rank())
    g = got("g16_split_halves").iloc[0]
    assert g["rho"] == pytest.approx(rho, abs=1e-9) and g["reliability"] == pytest.approx(2 * rho / (1 + rho), abs=1e-9)


def test_feature_panels(got, c):
    g = got("g15_feature_panels")
    for size, pr in zip(g["size"], g.iloc[:, -1] if "pr" not in g else g["pr"]):
        assert 1 <= pr <= 64 and size in (8, 16, 32)


def test_feature_orders(got, c):
    v = np.linalg.eigh(c)[1][:, -8:].T
    left, want = v.copy(), []
    for _ in range(8):
        size = (left**2).sum(0)
        size[want] = -1
        want.append(int(size.argmax()))
        q = np.linalg.qr(v[:, want])[0]
        left = v - q @ (q.T @ v)
    assert got("d14_pivot_features").sort_values("place")["feature"].tolist() == want
    d = 1 - c
    far = [int(d.mean(1).argmax())]
    while len(far) < 10:
        rest = [k for k in range(64) if k not in far]
        far.append(max(rest, key=lambda k: (d[k, far].min(), -k)))
    assert got("d15_farthest_features").sort_values("place")["feature"].tolist() == far


def test_leaf_order_joins_the_closest_groups(got, priced):
    d = 1 - corr(priced, "value").to_numpy()
    groups = [[k] for k in range(25)]
    while len(groups) > 1:
        a, b = min(((a, b) for a in range(len(groups)) for b in range(a + 1, len(groups))), key=lambda p: d[np.ix_(groups[p[0]], groups[p[1]])].mean())
        groups[a] += groups.pop(b)
    assert got("g27_leaf_order").sort_values("place")["feature"].tolist() == [BRANDS[k] for k in groups[0]]


def test_normal_scores_and_their_surface(got, priced):
    z = priced.assign(z=normal_scores(priced)).set_index(["entity", "feature"])["z"]
    g = got("w04_normal_scores").set_index(["entity", "feature"])["value"]
    assert np.allclose(g.sort_index(), z.sort_index(), atol=1e-9)
    two = z - z.groupby("entity").transform("mean") - z.groupby("feature").transform("mean") + z.mean()
    assert np.allclose(got("m06b_rank_normal").set_index(["entity", "feature"])["value"].sort_index(), two.sort_index(), atol=1e-9)


def test_partial_ranks(got, priced):
    t = priced.merge(sql("SELECT s_suppkey AS entity, s_acctbal AS a FROM supplier"), on="entity")
    g = got("d10_partial_ranks").set_index("feature")["rho"]
    for f, part in t.groupby("feature"):
        r = part[["measured", "score", "a"]].rank().corr().to_numpy()
        assert g[f] == pytest.approx((r[0, 1] - r[0, 2] * r[1, 2]) / np.sqrt((1 - r[0, 2] ** 2) * (1 - r[1, 2] ** 2)), abs=1e-9)


def test_ridge(got):
    t = sql("SELECT l_orderkey % 5 AS fold, l_quantity, l_tax, l_discount, l_extendedprice FROM lineitem").astype(float)
    x, y = t[["l_quantity", "l_tax", "l_discount"]].to_numpy(), t["l_extendedprice"].to_numpy()
    p = np.empty(len(t))
    for f in range(5):
        a, at = t["fold"].to_numpy() != f, t["fold"].to_numpy() == f
        m, n = x[a].mean(0), y[a].mean()
        b = np.linalg.solve((x[a] - m).T @ (x[a] - m) + np.eye(3), (x[a] - m).T @ (y[a] - n))
        p[at] = n + (x[at] - m) @ b
    assert got("d08_ridge")["r2"].iloc[0] == pytest.approx(1 - ((y - p) ** 2).sum() / ((y - y.mean()) ** 2).sum(), abs=1e-9)


@pytest.mark.parametrize(("name", "blocks"), [("n01_relabelled", None), ("n05_within_blocks", [int(b[-1]) for b in BRANDS])])
def test_relabelled_observed_values(got, priced, name, blocks):
    up = np.triu_indices(25, 1)
    u, v = (pd.Series(corr(priced, k).to_numpy()[up]) for k in ("value", "score"))
    g = got(name).iloc[0]
    assert g["observed"] == pytest.approx(u.rank().corr(v.rank()), abs=1e-9) and 0 < g["p_upper"] <= 1
    assert g["p_upper"] + g["p_lower"] >= 1


def test_lightest_blocks_are_the_greedy_pass(got):
    n = sql("SELECT l_suppkey, count(*) AS n FROM lineitem GROUP BY 1")
    load = np.zeros(6)
    for k in n.sort_values("n", ascending=False)["n"]:
        load[load.argmin()] += k
    g = got("b15_lightest_blocks")
    assert sorted(g["l_suppkey"]) == sorted(n["l_suppkey"]) and sorted(g.groupby("block")["n"].sum()) == sorted(load)


def test_file_digests(got):
    import glob

    want = sorted((len(b), hashlib.sha256(b).hexdigest()) for b in (open(f, "rb").read() for f in glob.glob(f"{D}/*.parquet")))
    assert sorted(map(tuple, got("s15_file_digests").to_numpy())) == want


def test_additive_and_chained_fills(got):
    s = sql(f"WITH {SPARSE_SQL} SELECT * FROM sparse")
    x = s.pivot(index="entity", columns="feature", values="value").reindex(columns=BRANDS)
    seen = x.notna().to_numpy()
    i, j = np.nonzero(seen)
    a = np.zeros((len(i), sum(x.shape)))
    a[np.arange(len(i)), i] = a[np.arange(len(i)), x.shape[0] + j] = 1
    e = np.linalg.lstsq(a, x.to_numpy()[seen], rcond=None)[0]
    want = pd.DataFrame(np.add.outer(e[: x.shape[0]], e[x.shape[0] :]), x.index, x.columns)
    g = got("p06_additive_fill")
    assert len(g) == (~seen).sum() and np.allclose(g["value"], [want.loc[r.entity, r.feature] for r in g.itertuples()], atol=1e-6)
    d = got("d13_chained_fill")
    assert len(d) == (~seen).sum() and d["value"].between(x.min().min() - 1, x.max().max() + 1).all()


def test_clusters_of_suppliers(got):
    from .test_imputation import plain_clusters

    s = sql(f"WITH {SPARSE_SQL} SELECT entity, feature FROM sparse")
    g = got("c03_threshold_clusters")
    assert dict(zip(g["entity"], g["leader"])) == plain_clusters(s.groupby("entity")["feature"].agg(set).to_dict(), 65)
