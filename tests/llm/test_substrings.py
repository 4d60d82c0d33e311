import random
from hashlib import sha256

from pyspark.sql import functions as F

from matrixloom.llm import substring_dedup as S


def plain(rows, window=50):
    first = {}
    for k, t in rows:
        w = (t or "").encode().split()
        for i in range(len(w) - window + 1):
            g = tuple(w[i : i + window])
            if k is not None:
                first[g] = min(first.get(g, k), k)
    out = []
    for k, t in rows:
        w = (t or "").encode().split()
        gone = set()
        for i in range(len(w) - window + 1):
            if k is not None and first[tuple(w[i : i + window])] < k:
                gone.update(range(i, i + window))
        kept = b" ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((k, len(w), len(gone), sha256(kept).hexdigest()))
    return sorted(out, key=str)


def run(docs, **how):
    out = S.removals(docs, **how).select(F.when(F.col("doc") > -(1 << 63), F.col("doc")).alias("k"), "n_words", "n_removed", F.sha2("kept", 256).alias("h"))
    return sorted((tuple(r) for r in out.collect()), key=str)


def test_cover_gives_every_difference():
    assert {(a - b) % S.PERIOD for a in S.COVER for b in S.COVER} == set(range(S.PERIOD))


def test_prose_in_many_chunks(make, prose):
    rows = [*enumerate(prose), (None, prose[5]), (None, prose[5]), (7, prose[7]), (500, None), (501, prose[3] + " tail")]
    assert run(make(rows), chunk=1500) == plain(rows)
    assert run(make(rows)) == plain(rows)


def test_matches_of_every_offset_and_length(make):
    rng = random.Random(2)
    base = [f"w{k}" for k in range(400)]
    rows = []
    for k in range(120):
        n, at = rng.randint(45, 90), rng.randint(0, 300)
        rows.append((k, " ".join([f"x{k}_{i}" for i in range(rng.randint(0, 40))] + base[at : at + n] + [f"y{k}_{i}" for i in range(rng.randint(0, 40))])))
    assert run(make(rows), chunk=2000) == plain(rows)


def test_few_words_that_repeat_within_documents(make):
    rng = random.Random(3)
    rows = [(k % 25, " ".join(rng.choice("ab") for _ in range(rng.randint(0, 300)))) for k in range(20)] + [(30, "a " * 500), (31, "a " * 49), (32, "a " * 120)]
    assert run(make(rows), chunk=700) == plain(rows)


def test_columns_stay_and_untouched_texts_too(spark, make, prose):
    docs = make([*enumerate(prose), (900, None)]).withColumn("kept", F.lit(1)).withColumn("chunk", F.lit("c"))
    out = S.substring_dedup(docs)
    assert out.columns == docs.columns
    whole = {k for k, _, gone, _ in plain(list(enumerate(prose))) if not gone}
    for r in out.collect():
        if r["doc_id"] in whole:
            assert r["text"] == prose[r["doc_id"]]
    assert S.substring_dedup(docs.limit(0)).isEmpty()


def test_a_very_long_text(make):
    text = " ".join(f"w{k % 9973}" for k in range(120_000))
    rows = [(1, text), (2, "start " + text[: len(text) // 2])]
    assert run(make(rows)) == plain(rows)


def thue_morse(n):
    return "".join("ab"[k.bit_count() & 1] for k in range(n))


def test_words_that_polynomials_confuse(make):
    """The Thue-Morse word and its complement meet under every polynomial hash modulo a power of two."""
    one = thue_morse(1024)
    other = one.translate(str.maketrans("ab", "ba"))
    tail = " ".join(f"w{k}" for k in range(49))
    rows = [(1, f"{one} {tail}"), (2, f"{other} {tail}"), (3, f"{one[:200]} {tail}"), (4, f"{other[:200]} {tail}")]
    rows += [(k, " ".join(thue_morse(300))) for k in (5, 6)] + [(7, " ".join(thue_morse(300).translate(str.maketrans("ab", "ba"))))]
    assert run(make(rows)) == plain(rows)
    assert run(make(rows[:4])) == [(k, 50, 0, h) for k, _, _, h in plain(rows[:4])]


def test_words_of_every_length_have_own_hashes():
    words = sorted({b"x" * n for n in range(1, 600)} | {b"x" * n + b"y" for n in range(600)} | {b"y" + b"x" * n for n in range(600)} | {bytes([a, b]) for a in range(65, 91) for b in range(65, 91)})
    for some in (words, words[::-1]):
        w = S.words_of([b" ".join(some[:700]), b"", b" ".join(some[700:])], 2)
        for h in w.hashes:
            assert len(set(h.tolist())) == len(words)
    again = S.words_of([b"\t".join(words)], 2)
    assert {tuple(x) for x in zip(*(h.tolist() for h in w.hashes))} == {tuple(x) for x in zip(*(h.tolist() for h in again.hashes))}


def test_many_equal_rows_and_the_least_key(spark, make):
    text = " ".join(f"w{k}" for k in range(60))
    docs = spark.range(100_000).selectExpr("7L AS doc_id", f"'{text}' AS text").union(make([(-(1 << 63), text), (8, text), (None, text)]).select("doc_id", "text"))
    out = S.removals(docs).groupBy("doc", "n_words", "n_removed").count()
    assert sorted((tuple(r) for r in out.collect()), key=str) == sorted([(7, 60, 60, 100_000), (-(1 << 63), 60, 0, 1), (8, 60, 60, 1), (None, 60, 0, 1)], key=str)
    parts = docs.where("doc_id = 7").select(F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(9)).alias("chunk")).groupBy("chunk").count().collect()
    assert len(parts) == 9 and max(r["count"] for r in parts) < 13_000
