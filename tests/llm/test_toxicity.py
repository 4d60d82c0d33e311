import zlib

import numpy as np
from pyspark.sql import functions as F

from matrixloom.llm import toxicity as X

DATA = "/root/testdata/sf0.1"


def auc(y, p):
    rank = np.argsort(np.argsort(p)) + 1
    return (rank[y == 1].sum() - y.sum() * (y.sum() + 1) / 2) / (y.sum() * (len(y) - y.sum()))


def test_held_out_accuracy_and_the_shape_of_the_result(spark):
    out = X.op4_toxicity(spark, DATA).toPandas()
    assert len(out) == 10_000 and out["score"].between(0, 1).all()
    assert ((out["score"] >= 0.3) == (out["predicted"] == 1)).all()
    assert all((zlib.crc32(str(k).encode()) % 4 == 2) == h for k, h in zip(out["doc_id"][:500], out["held_out"][:500]))
    x = out.merge(spark.read.parquet(f"{DATA}/labels.parquet").toPandas(), on="doc_id")
    x = x[x["held_out"]]
    y, p = x["toxic"].to_numpy(), x["predicted"].to_numpy()
    assert auc(y, x["score"].to_numpy()) > 0.95
    assert (p & y).sum() / y.sum() > 0.8 and (p & y).sum() / p.sum() > 0.85


def test_gram_hits_equal_sets_of_substrings():
    texts = ["abcabcab", "", None, "xyzé", "abc\nabc"]
    whose, what = X.gram_hits(texts)
    for k, t in enumerate(texts):
        grams = {(t or "")[i : i + n] for n in X.GRAMS for i in range(len(t or "") - n + 1)}
        assert (whose == k).sum() == len(grams)


def test_odd_rows_and_no_labels(spark, make):
    labelled = make([(k, "you idiot" if k % 4 == 0 else "good day") for k in range(40)]).withColumn("toxic", F.when(F.col("doc_id") < 38, (F.col("doc_id") % 4 == 0).cast("int")))
    model = X.fit(labelled)
    docs = make([(1, "what an IDIOT you are"), (2, "a good day"), (3, None), (3, ""), (None, "idiot"), (4, "x" * 200_000)]).withColumn("score", F.lit("clash"))
    got = {(r["doc_id"], r["score"] > 0.5) for r in X.scored(docs, model).collect()}
    assert (1, True) in got and (2, False) in got and (None, True) in got
    assert X.fit(labelled.limit(0)).scores(["a", None]).tolist() == [0.5, 0.5]
    assert X.scored(docs.limit(0), model).isEmpty()


def test_labels_of_held_out_rows_change_nothing(spark, tmp_path):
    d = "/root/testdata/sf0.001"
    labels = spark.read.parquet(f"{d}/labels.parquet")
    labels.withColumn("toxic", F.when(X.held_out(F.col("doc_id")), 1 - F.col("toxic")).otherwise(F.col("toxic"))).write.parquet(f"{tmp_path}/labels.parquet")
    spark.read.parquet(f"{d}/documents.parquet").write.parquet(f"{tmp_path}/documents.parquet")
    a, b = ({r["doc_id"]: round(r["score"], 9) for r in X.op4_toxicity(spark, p).collect()} for p in (d, str(tmp_path)))
    assert a == b


def test_counts_and_fit_equal_a_plain_version(spark, make):
    rows = [(k, f"you {'stupid fool' if k % 3 == 0 else 'kind friend'} number {k % 7}") for k in range(60)]
    labelled = make(rows).withColumn("toxic", (F.col("doc_id") % 3 == 0).cast("int"))
    grams = [{t[i : i + n] for n in X.GRAMS for i in range(len(t) - n + 1)} for _, t in rows]
    hashed = lambda g: int(X.gram_hits([g])[1][np.argsort(X.gram_hits([g])[0], kind="stable")][-1]) if len(g) == min(X.GRAMS) else None
    n = {}
    for (k, _), some in zip(rows, grams):
        for h in {hashed(g) for g in some if len(g) == 3}:
            n.setdefault(h, [0, 0])[k % 3 == 0] += 1
    got = {r["feature"]: (r["clean"], r["toxic"]) for r in X._counts(labelled.select("text", "toxic")).collect()}
    assert all(got[h][0] >= c[0] and got[h][1] >= c[1] for h, c in n.items())  # longer grams may share a hash
    assert sum(got[h] == tuple(c) for h, c in n.items()) > 0.9 * len(n)
    rng = np.random.default_rng(0)
    x = (rng.random((200, 6)) < 0.4) * rng.normal(size=6)
    y = (x.sum(1) + rng.normal(size=200) > 0).astype(float)
    row, column = np.nonzero(x)
    w, b = X._logistic(row, column, x[row, column], y, 6, 4000, 1e-2)
    p = 1 / (1 + np.exp(-(x @ w + b)))
    assert np.abs(x.T @ (p - y) / 200 + 1e-2 * w).max() < 1e-4 and abs((p - y).mean()) < 1e-4  # where the plain gradient is 0


def test_copies_of_a_key_count_once(spark, make):
    rows = [(1, "you fool")] * 50 + [(k, f"a kind word {k}") for k in range(2, 12)]
    labelled = make(rows).withColumn("toxic", (F.col("doc_id") == 1).cast("int"))
    once = make(list(dict.fromkeys(rows))).withColumn("toxic", (F.col("doc_id") == 1).cast("int"))
    a, b = X.fit(labelled, sample=11), X.fit(once, sample=11)
    assert np.allclose(a.scores(["you fool", "kind"]), b.scores(["you fool", "kind"]))


def plain_gram(gram):
    """The hash of one n-gram in whole numbers."""
    mask, h = (1 << 64) - 1, 0
    for c in gram:
        h = (h * 0x100000001B3 + ord(c)) & mask
    h ^= len(gram)
    h = ((h ^ (h >> 30)) * 0xBF58476D1CE4E5B9) & mask
    h = ((h ^ (h >> 27)) * 0x94D049BB133111EB) & mask
    return (h ^ (h >> 31)) >> (64 - X.HASH_BITS)


def test_ratios_features_and_scores_equal_a_plain_version(spark, make):
    """From texts to scores: counts of every gram, log-count ratios, the features of greatest z, a ridge fit at its optimum, scores of all texts."""
    rng = np.random.default_rng(5)
    words = ["kind", "Friend", "stupid", "FOOL", "table", "été", "paper", "x"]
    rows = []
    for k in range(120):
        bad = k % 4 == 0
        some = rng.choice(words, rng.integers(0, 9), p=[0.1, 0.1, 0.25, 0.25, 0.1, 0.1, 0.05, 0.05] if bad else [0.2, 0.2, 0.05, 0.05, 0.2, 0.1, 0.1, 0.1])
        rows.append((k, " ".join(some)))
    rows[7] = (7, None)
    labelled = make(rows).withColumn("toxic", (F.col("doc_id") % 4 == 0).cast("int"))
    grams = lambda t: {plain_gram(t[i : i + n]) for t in [t.lower()] for n in X.GRAMS for i in range(len(t) - n + 1)}
    sets, y = [grams(t or "") for _, t in rows], np.array([k % 4 == 0 for k, _ in rows], float)
    counts = {}
    for s, v in zip(sets, y):
        for h in s:
            counts.setdefault(h, [0, 0])[int(v)] += 1
    toxic, clean = y.sum(), (1 - y).sum()
    ratio = {h: np.log((c[1] + 1) / (toxic + 2)) - np.log((c[0] + 1) / (clean + 2)) for h, c in counts.items()}
    z = {h: abs(ratio[h]) / np.sqrt(1 / (counts[h][1] + 1) + 1 / (counts[h][0] + 1)) for h in counts}
    got = {r["feature"]: (r["clean"], r["toxic"]) for r in X._counts(labelled.select("text", "toxic")).collect()}
    assert got == {h: tuple(c) for h, c in counts.items()}
    model = X.fit(labelled, rounds=6000)
    chosen = np.flatnonzero(model.feature >= 0)
    assert set(chosen) == set(sorted(counts, key=lambda h: (-round(z[h], 12), h))[: X.FEATURES])
    columns = chosen[np.argsort(model.feature[chosen])]
    x = np.array([[ratio[h] if h in s else 0.0 for h in columns] for s in sets])
    full = np.column_stack([x, np.ones(len(x))])
    keep = np.append(np.full(len(columns), 1e-3), 0.0)
    w = np.zeros(full.shape[1])
    for _ in range(60):  # Newton's steps
        p = 1 / (1 + np.exp(-full @ w))
        w -= np.linalg.solve((full.T * (p * (1 - p))) @ full / len(y) + np.diag(keep + 1e-12), full.T @ (p - y) / len(y) + keep * w)
    want = 1 / (1 + np.exp(-(np.array([[ratio[h] if h in grams(t or "") else 0.0 for h in columns] for _, t in rows]) @ w[:-1] + w[-1])))
    assert np.abs(model.scores([t for _, t in rows]) - want).max() < 5e-3
