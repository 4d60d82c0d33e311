"""Assignments against all permutations, and by their prices where there are too many."""

from __future__ import annotations

from itertools import permutations

import numpy as np
import pytest

from matrixloom.operators import assignment as A

RNG = np.random.default_rng(3)


@pytest.mark.parametrize(("rows", "columns"), [(1, 1), (2, 5), (5, 5), (6, 7), (7, 7)])
def test_least_total_equals_all_permutations(rows, columns):
    for kind in (RNG.normal(size=(rows, columns)), RNG.integers(0, 3, (rows, columns)).astype(float)):
        to, u, v = A.assigned(kind)
        least = min(kind[range(rows), list(p)].sum() for p in permutations(range(columns), rows))
        assert kind[range(rows), to].sum() == pytest.approx(least) and len(set(to)) == rows
        assert (kind - u[:, None] - v).min() > -1e-9 and u.sum() + v[to].sum() == pytest.approx(least)


def test_a_thousand_items_are_proven():
    cost = RNG.random((1000, 1000))
    to, u, v = A.assigned(cost)
    assert sorted(to) == list(range(1000)) and (cost - u[:, None] - v).min() > -1e-9
    assert u.sum() + v.sum() == pytest.approx(cost[range(1000), to].sum())


def test_groups_and_missing_costs(spark):
    costs = {g: RNG.random((4, 4)) for g in "ab"}
    rows = [(g, f"r{i}", f"c{j}", float(c[i, j])) for g, c in costs.items() for i in range(4) for j in range(4)]
    rows += [("x", "r0", "c0", 1.0), ("x", "r0", "c1", None), ("x", "r1", "c0", 0.1), ("x", "r1", "c1", 5.0)]
    got = {}
    for r in A.assign(spark.createDataFrame(rows, "g string, i string, j string, cost double").repartition(3), ["g"]).collect():
        got.setdefault(r["g"], {})[r["i"]] = r["j"]
    for g, c in costs.items():
        best = min(permutations(range(4)), key=lambda p: c[range(4), list(p)].sum())
        assert got[g] == {f"r{i}": f"c{j}" for i, j in enumerate(best)}
    assert got["x"] == {"r0": "c0", "r1": "c1"}
    lost = spark.createDataFrame([("x", 0, 0, 1.0), ("x", 1, 0, 2.0), ("x", 2, 0, 1.0), ("x", 2, 1, 1.0), ("x", 2, 2, 1.0)], "g string, i int, j int, cost double")
    with pytest.raises(Exception, match="no assignment"):
        A.assign(lost, ["g"]).collect()
    assert A.assign(lost.limit(0), ["g"]).isEmpty()
