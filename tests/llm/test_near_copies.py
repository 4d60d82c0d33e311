import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from matrixloom.llm import components, simhash


def plain_fp(text):
    w = (text or "").encode().lower().split()
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(b" ".join(w[i : i + 3]), 42) for i in range(max(1, len(w) - 2))]
    return sum(1 << k for k in range(64) if 2 * sum(x >> k & 1 for x in h) > len(h))


def plain_components(fps, distance):
    root = list(range(len(fps)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= distance:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(fps))]


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def test_fingerprints_equal_a_plain_loop(prose):
    for t in [*prose, "one", "ONE two", "É x y Z", "a " * 70_000]:
        assert simhash.fingerprint(t) == plain_fp(t)


def linked(spark, fps, distance, pairwise):
    df = spark.createDataFrame([(signed(f),) for f in set(fps)], "fp long")
    found = {r["node"]: r["component"] for r in components.connected_components(simhash.links(df, distance, pairwise)).collect()}
    groups = {}
    for k, f in enumerate(fps):
        groups.setdefault(found.get(signed(f), signed(f)), []).append(k)
    return sorted(groups.values())


def test_links_connect_all_within_the_distance(spark):
    rng = random.Random(4)
    fps = [rng.getrandbits(64) for _ in range(60)]
    for _ in range(240):
        f = rng.choice(fps)
        for k in rng.sample(range(64), rng.randint(0, 4)):
            f ^= 1 << k
        fps.append(f)
    fps += [0, 1, 3, (1 << 64) - 1, 1 << 63]
    for distance in (0, 1, 2):
        groups = {}
        for k, r in enumerate(plain_components(fps, distance)):
            groups.setdefault(r, []).append(k)
        for pairwise in (1, 1000):
            assert linked(spark, fps, distance, pairwise) == sorted(groups.values())


def test_components_of_rows(spark, make, prose):
    rows = [(k + 5, t) for k, t in enumerate(prose)] + [(None, prose[3]), (2, None), (2, None), (None, "alone one two")]
    got = sorted((tuple(r) for r in simhash.near_duplicates(make(rows)).collect()), key=str)
    fps = [plain_fp(t) for _, t in rows]
    roots = plain_components(fps, 2)
    least = {}
    for (k, _), r in zip(rows, roots):
        least[r] = min([x for x in (least.get(r), k) if x is not None], default=None)
    assert got == sorted([(k, signed(f), least[r]) for (k, _), f, r in zip(rows, fps, roots)], key=str)
    assert simhash.near_duplicates(make([])).isEmpty()


def test_components_of_chains_and_stars(spark):
    edges = [(k, k + 1) for k in range(40)] + [(100, k) for k in range(101, 160)] + [(7, 7), (300, 301), (301, 300)]
    df = spark.createDataFrame(edges, "a long, b long")
    got = {r["node"]: r["component"] for r in components.connected_components(df).collect()}
    want = {k: 0 for k in range(41)} | {k: 100 for k in range(100, 160)} | {300: 300, 301: 300}
    assert got == want


@pytest.mark.parametrize("distance", [3, 5])
def test_crowded_keys_lose_no_link_at_wider_distances(spark, distance):
    rng = random.Random(distance)
    centre = [rng.getrandbits(64) for _ in range(3)]
    fps = []
    for _ in range(150):
        f = rng.choice(centre)
        for k in rng.sample(range(64), rng.randint(0, 4)):
            f ^= 1 << k
        fps.append(f)
    groups = {}
    for k, r in enumerate(plain_components(fps, distance)):
        groups.setdefault(r, []).append(k)
    assert linked(spark, fps, distance, 16) == sorted(groups.values())


def shingles(text, k=5):
    w = text.lower().split()
    return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def plain_alike(texts, distance=simhash.WIDE_DISTANCE):
    """Least number of each text's component under the rule that is documented, by comparing all pairs."""
    rows = simhash.wide_fingerprints(texts)
    fps = [x.tobytes() for x in rows]
    runs = simhash.chains(rows, simhash.chain_width(len(set(fps))))
    ids = rows_ids(rows)
    root = list(range(len(fps)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    def join(i, j):
        a, b = find(i), find(j)
        root[max(a, b)] = min(a, b)

    for i in range(len(fps)):
        for j in range(i):
            if fps[i] == fps[j]:
                join(i, j)
    for k in range(runs.shape[1]):
        buckets = {}
        for i, r in enumerate(runs[:, k].tolist()):
            buckets.setdefault(r, []).append(i)
        for some in buckets.values():
            first = min(some, key=ids.__getitem__)
            for i in some:
                if (int.from_bytes(fps[first]) ^ int.from_bytes(fps[i])).bit_count() <= distance:
                    join(first, i)
    return [find(i) for i in range(len(fps))]


def rows_ids(rows):
    """Spark's hash of eight longs."""
    from pyspark.sql import SparkSession

    spark = SparkSession.getActiveSession()
    df = spark.createDataFrame([(k, x) for k, x in enumerate(rows.view(np.int64).tolist())], "k long, fp array<long>")
    return [r[0] for r in df.orderBy("k").select(F.xxhash64("fp")).collect()]


def test_chains_are_runs_of_bits_around_the_ring():
    fps = np.random.default_rng(1).integers(0, 256, (5, simhash.WIDE // 8), np.uint8)
    for row, runs in zip(fps, simhash.chains(fps, 19)):
        bits = "".join(f"{b:08b}" for b in row) * 2
        assert runs.tolist() == [int(bits[simhash.SEGMENT * k : simhash.SEGMENT * k + 19], 2) for k in range(simhash.WIDE // simhash.SEGMENT)]


def test_isolated_pairs_are_found_at_the_widths_of_large_tables():
    """Pairs with a Jaccard index of 0.8 or more, each by itself: nothing but their own chains can link them. Widths are those of 60 thousand, 16 million and 10 ** 9 fingerprints."""
    rng = random.Random(6)
    pairs = []
    while len(pairs) < 600:
        a = [f"w{rng.randrange(10**6)}" for _ in range(rng.choice((60, 150, 400)))]
        b = list(a)
        for _ in range(rng.randint(1, max(1, len(a) // 22))):
            k = rng.randrange(len(b))
            b[k : k + 1] = rng.choice(([], [f"x{rng.randrange(10**6)}"], [b[k], f"x{rng.randrange(10**6)}"]))
        x, y = ({tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in (a, b))
        if len(x & y) >= 0.8 * len(x | y):
            pairs.append((" ".join(a), " ".join(b)))
    one, other = (simhash.wide_fingerprints([p[k] for p in pairs]) for k in (0, 1))
    near = np.unpackbits(one ^ other, axis=1).sum(1) <= simhash.WIDE_DISTANCE
    for width, least in ((20, 0.97), (28, 0.9), (34, 0.7)):
        assert (near & (simhash.chains(one, width) == simhash.chains(other, width)).any(1)).mean() >= least


def test_wide_fingerprints_vote_over_distinct_shingles():
    one = "the quick brown fox jumps over the lazy dog again"
    a, b, c, d, e = simhash.wide_fingerprints([one, one.upper() + " ", None, "", "one two"])
    assert (a == b).all() and not c.any() and not d.any() and e.any()
    again = simhash.wide_fingerprints([" ".join([one] * 3), "x " * 1000, "x x x x x"])
    assert (simhash.wide_fingerprints([" ".join([one] * 9)])[0] == again[0]).all() and (again[1] == again[2]).all()


def planted(rng, groups=60):
    """Texts with edited copies: some words of each copy are replaced."""
    word = lambda: "".join(rng.choice(("ba", "de", "li", "mo", "ru", "sa", "ti")) for _ in range(rng.randint(1, 4)))
    out = []
    for _ in range(groups):
        base = [word() for _ in range(rng.randint(60, 400))]
        out.append(" ".join(base))
        for _ in range(3):
            copy = [word() if rng.random() < 0.008 else w for w in base]
            out.append(" ".join(copy))
    return out


def test_planted_near_copies_are_found_and_others_left_alone(make):
    texts = planted(random.Random(8))
    sets = [shingles(t) for t in texts]
    part = {r["doc"]: r["component"] for r in simhash.alike(make([*enumerate(texts)])).collect()}
    pairs = [(i, j, len(sets[i] & sets[j]) / len(sets[i] | sets[j])) for i in range(len(texts)) for j in range(i)]
    near = [(i, j) for i, j, x in pairs if x >= 0.8]
    assert len(near) > 150
    assert np.mean([part[i] == part[j] for i, j in near]) >= 0.9
    assert all(i // 4 == part[i] // 4 for i in part)


def test_alike_rows_equal_a_plain_loop(make, prose):
    rows = [(k + 5, t) for k, t in enumerate(prose)] + [(None, prose[3]), (2, None), (2, None), (None, "alone one two")]
    docs = make(rows).withColumn("component", F.lit("clash")).withColumn("fp", F.lit(1))
    got = sorted((tuple(r) for r in simhash.alike(docs).collect()), key=str)
    least = {}
    roots = plain_alike([t for _, t in rows])
    for (k, _), r in zip(rows, roots):
        least[r] = min([x for x in (least.get(r), k) if x is not None], default=None)
    assert got == sorted([(k, least[r]) for (k, _), r in zip(rows, roots)], key=str)
    assert simhash.alike(make([])).isEmpty()


def test_a_large_group_makes_few_candidates(spark):
    texts = planted(random.Random(9), 4)
    fps = simhash.wide_fingerprints(texts).view(np.int64).tolist()
    nodes = spark.createDataFrame([*enumerate(fps)], "id long, fp array<long>")
    for width in (1, 12):  # one bit puts half of all in each chain
        found = {(r["a"], r["b"]) for r in simhash.chain_links(nodes, width).collect()}
        assert all(a // 4 == b // 4 for a, b in found)
    assert {r["node"]: r["component"] for r in components.connected_components(simhash.chain_links(nodes, 12)).collect()} == {k: k // 4 * 4 for k in range(16)}


def test_very_long_texts_and_columns_that_clash(make):
    long = " ".join(f"w{k % 7001} q{k}" for k in range(40000))
    docs = make([(1, long), (2, long + " end"), (3, "other words here")])
    docs = docs.withColumns({c: docs["lang"] for c in ("fp", "doc", "component", "least", "node", "id")})
    assert sorted((r["doc"], r["component"]) for r in simhash.near_duplicates(docs).collect()) == [(1, 1), (2, 1), (3, 3)]
    assert sorted((r["doc"], r["component"]) for r in simhash.alike(docs).collect()) == [(1, 1), (2, 1), (3, 3)]
