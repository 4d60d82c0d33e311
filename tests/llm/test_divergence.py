import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from matrixloom.llm import divergence as D

SCHEMA = "doc_id long, text string, lang string, source string, term string, n long, rank string"


def plain(rows, least, top):
    rows = [((x or ""), (y or ""), Counter(w.lower() if w.isascii() else "".join(c.lower() if c.isascii() else c for c in w) for w in re.findall("[^\x00-\x40\x5b-\x60\x7b-\x7f]+", t or ""))) for x, y, t in rows]
    out = []
    for lang in {x for x, _, _ in rows}:
        kept = sorted(t for t, n in Counter(t for x, _, c in rows if x == lang for t in c).items() if n >= least)
        count = {}
        for x, y, c in rows:
            if x == lang:
                count.setdefault(y, Counter()).update({t: c[t] for t in kept if t in c})
        whole = sum(count.values(), Counter())
        share = lambda c: {t: 1 + 10**9 * (c[t] + 2) // (sum(c.values()) + 2 * len(kept)) for t in kept}  # noqa: E731, B023
        price = lambda p, q: (p - q) ** 2 // (p + q)
        p, q = {y: share(c) for y, c in count.items()}, share(whole)
        for y in p:
            pairs = [(-sum(price(p[y][t], p[z][t]) for t in kept), z) for z in p if z != y]
            terms = sorted((-price(p[y][t], q[t]), t) for t in kept if count[y][t] and p[y][t] > q[t])[:top]
            out += [(lang, y, part, item, -v, k + 1) for part, some in (("pair", sorted(pairs)), ("term", terms)) for k, (v, item) in enumerate(some)]
    return sorted(out)


@pytest.mark.parametrize(("vocab", "least"), [(12, 2), (400, 1), (30, 500)])
def test_audit_equals_plain_sums(spark, vocab, least):
    """Vocabularies of one, three and no levels; hot source, nulls, empty texts, repeated rows and a source in two languages."""
    rng = random.Random(vocab)
    words = ["".join(rng.choice("abcÉßx") for _ in range(rng.randint(1, 5))) + ("Q" if k % 2 else "") for k in range(vocab)]
    rows = []
    for k in range(90):
        source = rng.choice(["hot", "hot", "hot", "b", "C", None, "é"])
        rows.append((k, rng.choice(["-", " ", "1"]).join(rng.choice(words[: 1 + rng.randrange(vocab)]) for _ in range(rng.randint(0, 60))), rng.choice(["en", "en", "de", None]), source))
    rows += [rows[5], rows[5], (200, None, "en", "nothing"), (201, "", "solo", "one"), (202, "a " * 5000 + "b", "en", "long")]
    docs = spark.createDataFrame([(*r, "clash", 1, "clash") for r in rows], SCHEMA).repartition(4)
    got = sorted(tuple(r) for r in D.divergence(docs, least=least, top=4).collect())
    assert got == plain([(r[2], r[3], r[1]) for r in rows], least, 4)
    assert D.divergence(docs.limit(0)).isEmpty()


def test_equal_subtrees_are_one_node_and_are_priced_once(spark):
    """Groups of equal counts share all nodes; blocks that repeat within a group are one node pair with a multiplicity."""
    cells = spark.createDataFrame([("x", s, i, 3) for s in ("a", "b") for i in range(1024)], "lang string, source string, id long, n long")
    roots, nodes = D.segment_trees(cells, 1024)
    assert [n.count() for n in nodes] == [1, 1] and roots.select("root").distinct().count() == 1
    pairs = spark.createDataFrame([("x", "a", "b", 3072, 3072, 1024)], "lang string, s string, t string, ns long, nt long, v long")
    assert D.pair_sums(pairs, roots, nodes).first()["more"] == 0


def test_shares_are_exact_for_large_counts(spark):
    row = spark.range(1).select(D.share(F.lit(10**13), F.lit(10**14 + 7), F.lit(10**6)).alias("p")).first()
    assert row["p"] == 1 + 10**9 * (10**13 + 2) // (10**14 + 7 + 2 * 10**6)
