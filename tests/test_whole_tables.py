"""Queries that once saw a part of their tables only, on tables whose other part tells."""

import numpy as np
import pandas as pd
import pytest

from matrixloom.operators import ranks as W
from matrixloom.operators import resample as B
from matrixloom.plans.registry import QUERIES

RNG = np.random.default_rng(5)


def upper(c):
    return c[np.triu_indices(len(c), 1)]


@pytest.fixture(scope="module")
def late(tmp_path_factory):
    """Embeddings whose first 2,000 rows by id are noise and whose 2,500 others hang together."""
    folder = tmp_path_factory.mktemp("late")
    x = RNG.normal(size=(4500, 64))
    x[2000:] += RNG.normal(size=(2500, 6)) @ RNG.normal(size=(6, 64)) * 2
    pd.DataFrame({"vec_id": np.arange(4500), "embedding": list(x)}).to_parquet(folder / "embeddings.parquet")
    return str(folder), x


def spectrum(x):
    y = x - x.mean(1, keepdims=True)
    return np.linalg.eigvalsh(np.corrcoef(y, rowvar=False))[::-1]


def test_n11_and_n14_observe_all_rows(spark, late):
    d, x = late
    w = spectrum(x)
    for kind in ("columns", "gaussian", "rows"):
        r = QUERIES[f"n11_null_{kind}"](spark, d).first()
        assert r["observed"] == pytest.approx(w.sum() ** 2 / (w**2).sum()) and r["draws"] == 30
        direct = [t["top"] for t in B.null_ratios(spark, x, 30, 18, kind).collect() if t["replicate"]]
        assert abs(r["mean"] - np.mean(direct)) < 4 * np.std(direct) / np.sqrt(15) and 0.5 < r["sd"] / np.std(direct) < 2
    got = {r["rank"]: r for r in QUERIES["n14_parallel_analysis"](spark, d).collect()}
    assert [got[f"e{k}"]["observed"] for k in range(10)] == pytest.approx(w[:10].tolist())
    assert [got[f"e{k}"]["kept"] for k in range(6)] == [1] * 6


def test_b01_and_g14_cover_all_rows(spark, late):
    d, x = late
    r = QUERIES["b01_row_bootstrap"](spark, d).first()
    whole = 64**2 / (np.corrcoef(x, rowvar=False) ** 2).sum()
    assert r["low"] < whole < r["high"] and abs(r["mean"] - whole) < 0.1 * whole
    again = [64**2 / (np.corrcoef(x[RNG.integers(0, 4500, 4500)], rowvar=False) ** 2).sum() for _ in range(60)]
    assert 0.6 < r["sd"] / np.std(again, ddof=1) < 1.6
    got = {r["size"]: r["mean"] for r in QUERIES["g14_recovery_curve"](spark, d).collect()}
    assert set(got) == {25.0, 50.0, 100.0} and 0.3 < got[25.0] < got[100.0]


def test_n15_counts_all_suppliers(spark, tmp_path):
    brands = [f"Brand#{k}" for k in range(1, 26)]
    m = RNG.random((2600, 25)) < 0.2
    m[2000:, :5] = RNG.random((600, 1)) < 0.5
    k, f = np.nonzero(m)
    pd.DataFrame({"p_partkey": np.arange(25), "p_brand": sorted(brands)}).to_parquet(tmp_path / "part.parquet")
    pd.DataFrame({"l_suppkey": k, "l_partkey": f, "l_quantity": 50.0, "l_extendedprice": 9.0}).to_parquet(tmp_path / "lineitem.parquet")
    r = QUERIES["n15_swapped_margins"](spark, str(tmp_path)).first()
    assert r["observed"] == pytest.approx(upper(m.T.astype(int) @ m).std()) and r["draws"] == 20


def test_trades_keep_both_margins_and_dealt_columns_their_values(spark):
    m = RNG.random((90, 12)) < 0.4
    rows = spark.createDataFrame([(k, [1.0 if v else None for v in r]) for k, r in enumerate(m.tolist())], "entity long, x array<double>")
    got = B.traded(rows, 12, 3, 4, block=20).toPandas()
    for _, part in got.groupby("replicate"):
        s = np.array(part["x"].tolist()) > 0
        assert (s.sum(0) == m.sum(0)).all() and sorted(s.sum(1)) == sorted(m.sum(1)) and sorted(s.tolist()) != sorted(m.tolist())
    x = RNG.normal(size=(300, 4))
    x[:, 1:] = x[:, :1]
    rows = spark.createDataFrame([(k, r) for k, r in enumerate(x.tolist())], "entity long, x array<double>")
    dealt = np.array(B.dealt_columns(rows, 4, 3, 50).toPandas()["x"].tolist())
    assert np.allclose(np.sort(dealt, 0), np.sort(x, 0)) and np.abs(upper(np.corrcoef(dealt, rowvar=False))).max() < 0.25


def test_hashed_draws_are_even():
    key = RNG.integers(-(1 << 62), 1 << 62, 20000)
    u, v = B.hashed(key, 3, 2), B.hashed(key, 4, 2)
    assert np.abs(u.mean(0) - 0.5).max() < 0.01 and np.abs(u.var(0) - 1 / 12).max() < 0.003
    assert max(abs(np.corrcoef(u[:, 0], c)[0, 1]) for c in (u[:, 1], v[:, 0], v[:, 1])) < 0.03
    w = B.poisson_weights(key, 1)
    assert abs(w.mean() - 1) < 0.03 and abs(w.var() - 1) < 0.05


def test_p10_normalises_whole_texts(spark, tmp_path):
    texts = ["Ａ-b " * 40 + "END_ß", "short", None]
    pd.DataFrame({"item_id": [0, 1, 2], "text": texts}).to_parquet(tmp_path / "benchmark.parquet")
    got = {r["item_id"]: r["name"] for r in QUERIES["p10_normal_names"](spark, str(tmp_path)).collect()}
    assert got == {0: "a b " * 40 + "end ss", 1: "short", 2: None}


def test_w22_all_finds_pairs_of_high_ids(spark, tmp_path):
    sets = {5: {1, 2}, 40: {1, 2, 3}, 900: {3}, 901: {9}}
    rows = [(k, p) for k, ps in sets.items() for p in ps] * 2
    pd.DataFrame(rows, columns=["l_suppkey", "l_partkey"]).to_parquet(tmp_path / "lineitem.parquet")
    got = {(r["one"], r["other"]): r["jaccard"] for r in QUERIES["w22_jaccard_all"](spark, str(tmp_path)).collect()}
    assert got == {(5, 40): pytest.approx(2 / 3), (40, 900): pytest.approx(1 / 3)}


def test_split_items_give_the_same_counts(spark):
    df = spark.createDataFrame([(k, p) for k in range(40) for p in range(6) if p == 0 or k % (p + 1) == 0], "k long, p long")
    counts = lambda crowd: sorted(map(tuple, W.shared_counts(df, "k", "p", crowd).collect()))
    assert counts(3) == counts(1000) and len(counts(3)) == 40 * 39 // 2


def test_pairs_of_many_owners_are_counted_where_lists_meet(spark):
    """What is shuffled is a row for each owner and item at most, never one for each pair."""
    rng = np.random.default_rng(5)
    held = sorted({(int(k), int(p)) for k, p in zip(rng.integers(0, 60, 900), rng.integers(0, 50, 900))})
    df = spark.createDataFrame(held, "k long, p long")
    items = {}
    for k, p in held:
        items.setdefault(k, set()).add(p)
    want = sorted((a, b, len(items[a]), len(items[b]), len(items[a] & items[b])) for a in items for b in items if a < b and items[a] & items[b])
    for few, crowd in ((10, 256), (10, 4), (1000, 4)):
        met = W.met_pairs(df, "k", "p", crowd, few)
        assert sorted(map(tuple, met.collect())) == want
    plan = W.met_pairs(df, "k", "p", 256, 10)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan[: plan.index("Generate")].replace("AdaptiveSparkPlan", "")


def test_t10_marks_the_upper_fraction_of_all_rows(spark, tmp_path):
    n = 300
    score = RNG.integers(0, 4000, n)
    score[:60] = 2500
    pd.DataFrame({"doc_id": np.arange(n), "lang": "en", "n_chars": score}).to_parquet(tmp_path / "documents.parquet")
    pd.DataFrame({"doc_id": np.arange(n), "toxic": np.arange(n) % 3 == 0}).astype({"toxic": "int64"}).to_parquet(tmp_path / "labels.parquet")
    got = {(r["share"], r["least"]): r for r in QUERIES["t10_upper_fractions"](spark, str(tmp_path)).collect()}
    assert len(got) == 4
    for (share, least), r in got.items():
        cut = np.sort(score)[::-1][int(np.ceil(n * round(share * 10) / 10)) - 1]
        assert (r["n"], r["marked"]) == ((score >= least).sum(), (score >= max(cut, least)).sum())
