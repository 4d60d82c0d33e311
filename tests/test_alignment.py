"""Global alignments against a plain dynamic programme over tuples."""

from __future__ import annotations

import random
from functools import lru_cache

import pytest

from matrixloom.operators import alignment as A


def plain(a, b, match, mismatch, opening, extending):
    @lru_cache(None)
    def best(i, j, last):
        """Best (score, matches, -columns) of the rest, given what the last column was."""
        if i == len(a) and j == len(b):
            return 0, 0, 0
        ways = []
        if i < len(a) and j < len(b):
            ways.append(((match, 1) if a[i] == b[j] else (mismatch, 0), best(i + 1, j + 1, 0)))
        if i < len(a):
            ways.append(((extending if last == 1 else opening, 0), best(i + 1, j, 1)))
        if j < len(b):
            ways.append(((extending if last == 2 else opening, 0), best(i, j + 1, 2)))
        return max((s + r[0], k + r[1], r[2] - 1) for (s, k), r in ways)

    s, k, c = best(0, 0, 0)
    return s, k, -c


@pytest.mark.parametrize("scores", [(1, 0, 0, 0), (2, -1, -3, -1), (5, -4, -20, -1), (1, -1, -1, -1)])
def test_alignments_equal_a_plain_programme(spark, scores):
    rng = random.Random(sum(scores))
    text = lambda: "".join(rng.choice("abcé") for _ in range(rng.randint(0, 12)))
    rows = [(k, text(), text()) for k in range(150)] + [(200, "", ""), (201, None, "abc"), (202, "a" * 300, "a" * 280 + "b"), (203, "abc", "abc")]
    df = spark.createDataFrame(rows, "k int, x string, y string").repartition(3)
    for r in A.identities(df, "x", "y", *scores).collect():
        if r["k"] == 202:
            assert r["matches"] == 280 and r["columns"] >= 300
            continue
        want = plain(r["x"] or "", r["y"] or "", *scores)
        assert (r["score"], r["matches"], r["columns"]) == want
        assert r["identity"] == (want[1] / want[2] if want[2] else None)
    assert A.identities(df.limit(0), "x", "y").isEmpty()
