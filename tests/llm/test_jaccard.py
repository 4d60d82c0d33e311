import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from matrixloom.llm import jaccard_join as J
from matrixloom.llm.common import distinct_shingles


def sets_of(text, shingle=3):
    w = "".join(c.lower() if c.isascii() else c for c in text or "").split()
    return {tuple(w[i : i + shingle]) for i in range(max(1, len(w) - shingle + 1))} if w else set()


def plain(rows, percent=90):
    keys = [k for k, _ in rows]
    sets = [sets_of(t) for _, t in rows]
    root = {k: k for k in keys}

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                a, b = find(keys[i]), find(keys[j])
                root[max(a, b)] = min(a, b)
    return sorted((k, len(s), find(k)) for k, s in zip(keys, sets))


def texts(rng, groups=12, size=9):
    word = lambda: "".join(rng.choice(("Ba", "de", "li", "mo", "é")) for _ in range(rng.randint(1, 4)))
    out = ["", " \n", "one", "One two", "one two", "one two three", "one  two\tthree"]
    for _ in range(groups):
        base = [word() for _ in range(rng.choice((8, 12, 30, 60, 150, 400)))]
        for _ in range(size):
            t = list(base)
            for _ in range(rng.randint(0, 1 + len(t) // 40)):
                at = rng.randrange(len(t))
                t[at : at + 1] = rng.choice(([], [word()], [word(), t[at]]))
            out.append(rng.choice((" ", "  ", "\n")).join(t))
    return out


@pytest.mark.parametrize(("percent", "crowd", "levels"), [(90, J.CROWD, J.LEVELS), (90, 1, 3), (70, 5, 2), (100, 5, 1)])
def test_components_equal_all_pairs(make, percent, crowd, levels):
    rng = random.Random(percent + crowd)
    rows = list(enumerate(texts(rng)))
    rng.shuffle(rows)
    got = J.similar_texts(make(rows), percent=percent, crowd=crowd, levels=levels)
    want = plain(rows, percent)
    assert sorted(tuple(r) for r in got.collect()) == want
    assert sum(k != c for k, _, c in want) > 10


def test_a_crowded_group_near_the_threshold(make):
    """Many copies whose indices lie on both sides of the threshold, in one size band: components are exact without all pairs at once."""
    rng = random.Random(9)
    base = [f"w{k}" for k in range(120)]
    rows = []
    for k in range(90):
        t = list(base)
        for at in rng.sample(range(120), rng.randint(1, 4)):
            t[at] = f"x{rng.randrange(10**6)}"
        rows.append((k, " ".join(t)))
    assert sorted(tuple(r) for r in J.similar_texts(make(rows), crowd=20).collect()) == plain(rows)


def test_linked_sets_share_a_signature():
    """Sets at the threshold, of sizes in one band and in neighbouring ones, under several partitions of the domain."""
    rng = np.random.default_rng(3)
    for n in [*range(1, 40), 95, 100, 333, 1000, 4001]:
        for level in (1, 2):
            a = rng.integers(0, 1 << 63, n, dtype=np.uint64)
            for extra in (0, n // 9, n // 9 // 2):
                new = rng.integers(0, 1 << 63, extra, dtype=np.uint64)
                b = np.concatenate([a, new])
                if extra:
                    lost = min(extra, max(0, int((n - 0.9 * len(b)) // 1.0)))
                    b = b[lost:]
                inter = len(np.intersect1d(a, b))
                if 100 * inter < 90 * (len(a) + len(b) - inter):
                    continue
                whose = np.repeat([0, 1], [len(a), len(b)])
                owner, sig = J.signatures(whose, np.concatenate([a, b]), np.array([len(a), len(b)]), level)
                assert set(sig[owner == 0].tolist()) & set(sig[owner == 1].tolist()), (n, extra, level)


def test_bands_hold_all_partners():
    for percent in (50, 70, 90, 99, 100):
        tops = J.size_bands(5000, percent)
        for n in range(1, 5000):
            assert np.searchsorted(tops, n * 100 // percent) <= np.searchsorted(tops, n) + 1


def test_odd_rows(make):
    long = " ".join(f"w{k % 5000} q{k}" for k in range(30000))
    rows = [(1, "a b c d"), (2, "A  b\nC d"), (None, "a b c d"), (None, "q r s t"), (3, None), (None, None), (4, ""), (4, ""), (5, long), (6, long + " end"), (7, "a b c d"), (7, "a b c d")]
    docs = make(rows).withColumn("n", F.lit(9)).withColumn("component", F.lit("clash")).withColumn("id", F.lit(0))
    got = sorted((tuple(r) for r in J.similar_texts(docs).collect()), key=str)
    n = len(sets_of(long))
    want = [(1, 2, 1), (2, 2, 1), (7, 2, 1), (7, 2, 1), (None, 2, 1), (None, 2, None), (3, 0, 3), (None, 0, None), (4, 0, 4), (4, 0, 4), (5, n, 5), (6, n + 1, 5)]
    assert got == sorted(want, key=str)
    assert J.similar_texts(docs.limit(0)).isEmpty()


def test_shingles_are_those_of_a_plain_split():
    whose, h = distinct_shingles(["a b a b a", None, "x", "É é", "a b a"], 3)
    assert np.bincount(whose, minlength=5).tolist() == [2, 0, 1, 1, 1]
    assert set(h[whose == 4].tolist()) < set(h[whose == 0].tolist())


@pytest.mark.parametrize(("gathered", "members", "shared"), [(64, 3, 50), (1 << 18, 512, 1 << 14)])
def test_components_are_the_same_however_pairs_are_placed(make, monkeypatch, gathered, members, shared):
    for name, value in (("GATHERED", gathered), ("MEMBERS", members), ("SHARED", shared)):
        monkeypatch.setattr(J, name, value)
    rows = list(enumerate(texts(random.Random(gathered), groups=6, size=12)))
    assert sorted(tuple(r) for r in J.similar_texts(make(rows), percent=80, crowd=5).collect()) == plain(rows, 80)


def test_a_set_goes_to_few_places_however_many_pairs_it_is_in(spark):
    """Before, each pair carried both of its sets."""
    pairs = spark.createDataFrame([(a, b) for b in range(60) for a in range(b)], "a long, b long")
    placed = J._placed(pairs, spark.range(60).select("id", F.lit(4000).cast("long").alias("longs")))
    assert placed.count() == 60 * 59 // 2
    assert J._places(placed).agg(F.sum(F.size("places"))).first()[0] == 60


def test_wide_sketches_tell_large_sets_apart_and_lose_no_link():
    rng = np.random.default_rng(11)
    for n in (5, 600, 4000):
        base = rng.integers(0, 1 << 63, n, dtype=np.uint64)
        sets = [base, *(np.concatenate([base[k:], rng.integers(0, 1 << 63, k, dtype=np.uint64)]) for k in (0, n // 50, n // 10, n // 9, n // 4, n // 2)), base[: n * 4 // 5]]
        sets = [np.sort(s) for s in sets]
        sizes = np.array([len(s) for s in sets])
        whose, h = np.repeat(np.arange(len(sets)), sizes), np.concatenate(sets)
        table = J.pd.DataFrame({"id": range(len(sets)), "n": sizes, "elements": [s.view(np.int64) for s in sets], "wide": [np.array(w, np.int64) for w in J._wide_sketches(whose, h, sizes).to_pylist()]})
        pairs = J.pd.DataFrame([(a, b) for b in range(len(sets)) for a in range(b)], columns=["a", "b"])
        near = {(a, b) for a, b in pairs.itertuples(index=False) if 100 * len(np.intersect1d(sets[a], sets[b])) >= 80 * len(np.union1d(sets[a], sets[b]))}
        got, left = ({tuple(p) for p in f(pairs, table, 80).itertuples(index=False)} for f in (J.linked, J.sketched))
        assert got == near and near <= left and (0, 7) in near
        assert n < 4000 or (0, 5) not in left and (0, 6) not in left


def test_linked_sets_share_an_element_of_their_prefixes():
    """In any order of elements, also one in which frequent ones come last."""
    rng = np.random.default_rng(8)
    for percent in (70, 80, 90, 100):
        for n in [*range(1, 40), 95, 333, 2000]:
            a = rng.integers(0, 1 << 63, n, dtype=np.uint64)
            gone = n * (100 - percent) // 100
            for b in (a[gone:], np.concatenate([a, rng.integers(0, 1 << 63, n * 100 // percent - n, dtype=np.uint64)])):
                assert 100 * len(np.intersect1d(a, b)) >= percent * len(np.union1d(a, b))
                known = np.sort(rng.choice(a, len(a) // 2, replace=False))
                for frequent in ((known[:0], np.empty(0, np.int64)), (known, rng.integers(2, 9, len(known)))):
                    whose, h = np.repeat([0, 1], [len(a), len(b)]), np.concatenate([np.sort(a), np.sort(b)])
                    owner, sig = J.prefixes(whose, h, np.array([len(a), len(b)]), percent, frequent)
                    assert np.bincount(owner).tolist() == [1 + len(s) * (100 - percent) // 100 for s in (a, b)]
                    assert set(sig[owner == 0].tolist()) & set(sig[owner == 1].tolist()), (n, percent)


def test_unlike_texts_seldom_meet(spark, make):
    """Texts of about the same length met in signatures of no element (2,772 rows here before); those with one passage in common would in its elements."""
    rng = random.Random(4)
    passage = [f"p{k}" for k in range(40)]
    docs = make([(k, " ".join([f"w{rng.randrange(10**9)}" for _ in range(rng.randint(120, 190))] + passage)) for k in range(600)])
    rows = J._described(docs, "doc_id", "text", 5).cache()
    classes = rows.where("n > 0").select(F.col("doc").alias("id"), "h1", "h2", "n", "sketch", "wide")
    shared = J._signed(docs, rows, classes, "doc_id", "text", 5, 80).groupBy("sig").count().where("count > 1")
    assert shared.isEmpty()


@pytest.mark.parametrize(("sample", "most"), [(1, 1 << 17), (20, 30), (1 << 14, 0)])
def test_components_are_the_same_whatever_elements_are_known_as_frequent(make, monkeypatch, sample, most):
    monkeypatch.setattr(J, "SAMPLE", sample)
    monkeypatch.setattr(J, "FREQUENT", most)
    rows = list(enumerate(texts(random.Random(sample), groups=6, size=12)))
    assert sorted(tuple(r) for r in J.similar_texts(make(rows), percent=80, crowd=30).collect()) == plain(rows, 80)


def passages(rng, documents):
    """Texts with 100 words of their own and six passages of 12 words, each of which one other text has."""
    ends = [k for k in range(documents) for _ in range(6)]
    rng.shuffle(ends)
    out = [[f"w{rng.randrange(10**9)}" for _ in range(100)] for _ in range(documents)]
    for at in range(0, len(ends), 2):
        words = [f"p{at}q{k}" for k in range(12)]
        for k in ends[at : at + 2]:
            out[k] += words
    return [(k, " ".join(t)) for k, t in enumerate(out)]


def test_texts_seldom_meet_in_passages_that_a_sample_misses(make, monkeypatch):
    """Rows of shared signatures, which grew with the square of the documents: 13,232 before of 2,400 texts, each with passages in common with six others."""
    monkeypatch.setattr(J, "SAMPLE", 50)
    docs = make(passages(random.Random(5), 2400))
    rows = J._described(docs, "doc_id", "text", 3).cache()
    classes = rows.where("n > 0").select(F.col("doc").alias("id"), "h1", "h2", "n", "sketch", "wide")
    signed = J._signed(docs, rows, classes, "doc_id", "text", 3, 90)
    assert (signed.groupBy("sig").count().where("count > 1").agg(F.sum("count")).first()[0] or 0) < 1200


@pytest.mark.parametrize(("sample", "counted"), [(1, 1), (1, 2), (20, 4), (1 << 14, 100)])
def test_components_are_the_same_however_many_elements_are_counted(make, monkeypatch, sample, counted):
    """Also where keys have several texts, whose elements are ranked together."""
    monkeypatch.setattr(J, "SAMPLE", sample)
    monkeypatch.setattr(J, "COUNTED", counted)
    rng = random.Random(sample + counted)
    some = texts(rng, groups=8) + [t for _, t in passages(rng, 30)]
    rows = list(enumerate(some))
    assert sorted(tuple(r) for r in J.similar_texts(make(rows), percent=80, crowd=30).collect()) == plain(rows, 80)
    keyed = [(rng.randrange(60), t) for t in {frozenset(sets_of(t)): t for t in some}.values()]
    links = [(a, b) for k, (a, s) in enumerate(keyed) for b, t in keyed[:k] if (x := sets_of(s)) and (y := sets_of(t)) and 100 * len(x & y) >= 80 * len(x | y)]
    root = {a: a for a, _ in keyed}
    for _ in root:
        for a, b in links:
            root[a] = root[b] = min(root[a], root[b])
    want = sorted((a, len(sets_of(t)), root[a] if sets_of(t) else a) for a, t in keyed)
    assert sorted(tuple(r) for r in J.similar_texts(make(keyed), percent=80, crowd=30).collect()) == want
