"""The largest complete rectangle against all subsets."""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pytest

from matrixloom.operators.rectangles import largest_complete


def plain(x, least):
    for size in range(x.shape[1], 0, -1):
        found = [(-int(x[:, s].all(1).sum()), s) for s in combinations(range(x.shape[1]), size) if x[:, s].all(1).sum() >= least]
        if found:
            n, s = min(found)
            return size, -n, "".join("01"[k in s] for k in range(x.shape[1]))
    return None


@pytest.mark.parametrize(("features", "fill", "least", "rows"), [(9, 0.6, 8, 1 << 17), (9, 0.6, 8, 3), (12, 0.75, 15, 20), (6, 0.9, 60, 5), (3, 0.5, 200, 9), (1, 0.5, 1, 9)])
def test_largest_rectangle_equals_all_subsets(spark, features, fill, least, rows):
    rng = np.random.default_rng(features * 7 + rows)
    x = rng.random((90, features)) < fill
    x[:30] |= rng.random(features) < 0.5  # a group of entities with a block in common
    names = [f"f{k}" for k in range(features)]
    cells = [(i, names[j], 1.0 if x[i, j] else None) for i in range(90) for j in range(features) if x[i, j] or rng.random() < 0.2]
    cells += [c for c in cells[:40]] + [(1, "other", 1.0)]  # repeated cells and a feature that isn't asked for
    got = [tuple(r) for r in largest_complete(spark.createDataFrame(cells, "entity int, feature string, value double"), names, least, rows).collect()]
    want = plain(x, least)
    assert got == ([] if want is None else [want])


def test_many_features_and_no_cells(spark):
    rng = np.random.default_rng(5)
    x = rng.random((200, 70)) < 0.3
    x[:40, 10:22] = True
    cells = spark.createDataFrame([(int(i), int(j), 1.0) for i, j in zip(*np.nonzero(x))], "entity int, feature int, value double")
    got = largest_complete(cells, list(range(70)), 40).first()
    assert got["features"] == 12 and got["entities"] >= 40 and got["members"] == "0" * 10 + "1" * 12 + "0" * 48
    assert largest_complete(cells.limit(0), list(range(70)), 1).isEmpty()
