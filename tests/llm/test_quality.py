from collections import Counter

from pyspark.sql import functions as F

from matrixloom.llm import quality


def repeats(words, k=8):
    grams = [tuple(words[i : i + k]) for i in range(len(words) - k + 1)]
    n = Counter(grams)
    return len({i + j for i, g in enumerate(grams) if n[g] > 1 for j in range(k)})


def test_repeated_words_equal_a_plain_count(prose):
    for t in [*prose, "a b c d e f g h " * 5, "x " * 30, "a b c d e f g h i j a b c d e f g h i q"]:
        words = t.encode().split()
        assert quality.repeated_words(words) == repeats(words)


def test_counts_of_odd_texts():
    assert quality.text_counts(None) == (0,) * 7
    assert quality.text_counts("") == (0,) * 7
    assert quality.text_counts("a|é\na|é\n \n \n#") == (3, 7, 3, 3, 1, 0, 1)
    assert quality.text_counts("a a b b b")[-1] == 3
    assert quality.text_counts("a b\x1cc\x85d\xa0e") == (2, 8, 0, 1, 0, 0, 0)


def test_buckets_keep_leading_bits(spark):
    rows = spark.range(0, 5000, 7).select("id", quality.bucket(F.col("id")).alias("edge")).collect()
    for r in rows:
        shift = max(0, r["id"].bit_length() - 6)
        assert r["edge"] == r["id"] >> shift << shift


def test_sketches_merge_by_adding(spark, small):
    rows = quality.measured(spark.read.parquet(f"{small}/documents.parquet")).cache()
    halves = [quality.sketches(rows.where(F.col("row.doc_id") % 2 == k)) for k in (0, 1)]
    key = ["lang", "source", "measure", "edge"]
    merged = halves[0].union(halves[1]).groupBy(*key).agg(F.sum("n").alias("n"))
    whole = quality.sketches(rows).select(*key, "n")
    assert merged.exceptAll(whole).isEmpty() and whole.exceptAll(merged).isEmpty()


def test_null_languages_and_clashing_columns(spark, prose):
    rows = [(k, t, None, None, 1, True) for k, t in enumerate(prose)] + [(None, None, None, "s", 2, False)] * 2
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_words int, kept boolean")
    kept = quality.quality_filter(docs)
    assert kept.columns == docs.columns
    want = [k for k, t in enumerate(prose) if len(t.encode().split()) >= 20]
    assert sorted(r["doc_id"] for r in kept.collect()) == want
    assert quality.quality_filter(docs.limit(0)).isEmpty()


def test_clean_labelled_documents_stay_and_most_junk_goes(spark):
    d = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{d}/labels.parquet")
    x = quality.op1_quality_rules(spark, d).join(labels, "doc_id").where("NOT base_failed").groupBy("quality").agg(F.avg(F.col("kept").cast("int")).alias("kept")).collect()
    share = {r["quality"]: r["kept"] for r in x}
    assert share[1] == 1.0 and share[0] < 0.2


def limits_of(docs):
    return {(r["lang"], r["source"]): r.asDict() for r in quality.thresholds(quality.sketches(quality.measured(docs))).collect()}


def test_groups_have_fences_of_their_own(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id", "text", "lang", "source")
    limits = limits_of(docs)
    assert len(limits) == 80
    for x in quality.MEASURES:
        assert len({r[f"{x}_high"] for r in limits.values()}) > len(limits) / 3


def test_only_the_fence_of_a_stretched_source_moves(spark):
    """One small source's words grow longer and lines longer; the sketches of the others move by its share alone."""
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang", "source")
    hit = (F.col("source") == "src7") & (F.col("lang") == "en")
    limits, moved = limits_of(d), limits_of(d.withColumn("text", F.when(hit, F.regexp_replace("text", "([a-z])([a-z])", "$1$1$2$2")).otherwise(F.col("text"))))
    for key, r in limits.items():
        for x in ("word_length_centi_low", "word_length_centi_high"):
            change = abs(moved[key][x] - r[x])
            assert change > 150 if key == ("en", "src7") else change < 0.25 * r[x]


def test_quartiles_lie_within_a_bucket_of_the_exact_ones(spark):
    """One group, so all three sketches that are blended are its own."""
    values = [int(v * v) for v in range(200)]
    rows = spark.createDataFrame([("en", "s", "x", v) for v in values], "lang string, source string, measure string, v long").withColumn("edge", quality.bucket(F.col("v")))
    q = quality.quartiles(rows.groupBy("lang", "source", "measure", "edge").agg(F.count(F.lit(1)).alias("n"))).first()
    for share in (25, 50, 75):
        assert abs(q[f"q{share}"] - sorted(values)[2 * share]) <= values[2 * share] / 16


def test_a_very_long_text(spark):
    long = " ".join(f"w{k % 997}x{k}" for k in range(300000))
    assert quality.text_counts(long)[0] == 300000
    docs = spark.createDataFrame([(1, long, "en", "s"), (2, "a " * 200000, "en", "s")], "doc_id long, text string, lang string, source string")
    assert [r["doc_id"] for r in quality.quality_filter(docs).collect()] == [1]
