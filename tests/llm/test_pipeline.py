import random
from hashlib import sha256

from pyspark.sql import functions as F

import corpus_pipeline as P

from . import test_lines, test_near_copies, test_substrings


def pairs(df):
    return sorted(((r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()), key=str)


def test_each_stage_equals_its_plain_form(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    verdicts = {r["doc_id"]: r["kept"] for r in __import__("matrixloom.llm.quality", fromlist=["x"]).op1_quality_rules(spark, small).select("doc_id", "kept").collect()}
    kept = P.quality_stage(spark, docs, small).cache()
    assert pairs(kept) == [p for p in pairs(docs) if verdicts[p[0]]] and kept.columns == P.COLUMNS
    assert 0 < kept.count() < docs.count()
    lines = P.line_stage(spark, kept, small).cache()
    assert pairs(lines) == sorted(((k, t) for k, _, _, t in test_lines.plain(pairs(kept))), key=str)
    assert lines.where(F.col("n_chars") != F.length("text")).isEmpty()
    single = P.near_copy_stage(spark, lines, small).cache()
    rows = sorted(pairs(lines))
    roots = test_near_copies.plain_alike([t for _, t in rows])
    assert sorted(pairs(single)) == [p for i, p in enumerate(rows) if roots[i] == i]
    cut = P.substring_stage(spark, single, small).cache()
    want = {k: (n, gone) for k, n, gone, _ in test_substrings.plain(pairs(single))}
    whole = dict(pairs(single))
    digest = {k: h for k, _, _, h in test_substrings.plain(pairs(single))}
    for k, t in pairs(cut):
        assert len(t.encode().split()) == want[k][0] - want[k][1]
        assert t == whole[k] if not want[k][1] else sha256(t.encode()).hexdigest() == digest[k]
    packed = P.packing_stage(spark, cut, small).toPandas()
    assert set(packed["doc_id"]) == {k for k, _ in pairs(cut)}
    assert packed.groupby("sequence_id")["length"].sum().max() <= 1024


def test_no_near_copy_is_left_however_wide_the_chains(spark, make, monkeypatch):
    """Chains as wide as those of very many documents lose pairs; every pair that has the index is linked all the same."""
    texts = test_near_copies.planted(random.Random(12), 30)
    sets = [test_near_copies.shingles(t) for t in texts]
    near = [(i, j) for i in range(len(texts)) for j in range(i) if 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])]
    monkeypatch.setattr(P.simhash, "chain_width", lambda n: 60)
    kept = {r["doc_id"] for r in P.near_copy_stage(spark, make([*enumerate(texts)]), "").collect()}
    assert len(near) > 60 and not {i for i, _ in near} & kept
    assert {k for k in range(0, len(texts), 4)} <= kept


def test_run_and_odd_rows(spark, small, tmp_path):
    assert P.run(spark, small).columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    rows = [(1, "word " * 3, "en", "s", 15), (None, " ".join(f"a{k}" for k in range(40)), None, None, None), (2, None, "en", None, None)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    assert [r["doc_id"] for r in P.run(spark, str(tmp_path)).collect()] == [None]


def test_empty_documents(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    assert P.run(spark, str(tmp_path)).isEmpty()
