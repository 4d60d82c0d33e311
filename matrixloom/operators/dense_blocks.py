"""Moments of every block of features over the entities that have all of it, from matrix products or from moments of sets of entities with the same features."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.tables import stored
from .geometry import values_of

#: Blocks that a task holds at once before it sums equal ones and passes them on.
HELD = 1 << 17
#: Cells of a task's table of products up to which blocks are summed as products of matrices; sets of features are enumerated beyond it. Rows of one product.
PRODUCTS, ROWS = 1 << 24, 2048


def _by_features(rows: DataFrame, names: list[str], origin: np.ndarray) -> DataFrame:
    """(has, n, s, q): entities with the same set of features as one row: their number, sums of their values from the origins, and sums of products, by name and within the set."""
    p, width = origin.shape[1], len(names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (x for x in batches if len(x)):
            x = np.stack([values_of(b.column(c), p) for c in names]) - origin[:, None]
            seen = ~np.isnan(x).any(0)
            keys = np.packbits(seen, axis=1)
            order = np.lexsort(keys.T)
            first = np.flatnonzero(np.append(True, (keys[order][1:] != keys[order][:-1]).any(1)))
            out = []
            for some in np.split(order, first[1:]):
                at = np.flatnonzero(seen[some[0]])
                z = x[:, some][:, :, at]
                out.append((at, len(some), z.sum(1).ravel(), np.einsum("wni,wnj->wij", z, z).ravel()))
            yield pa.RecordBatch.from_arrays([pa.array([v[k] for v in out], t) for k, t in enumerate((pa.list_(pa.int32()), pa.int64(), pa.list_(pa.float64()), pa.list_(pa.float64())))], ["has", "n", "s", "q"])

    def add(t: pa.Table) -> pa.Table:
        total = lambda c: pa.array([np.sum(t.column(c).to_pylist(), axis=0)], pa.list_(pa.float64()))
        return pa.table({"has": t.column("has").slice(0, 1), "n": [sum(t.column("n").to_pylist())], "s": total("s"), "q": total("q")})

    schema = "has array<int>, n long, s array<double>, q array<double>"
    return rows.select(*names).mapInArrow(run, schema).where(F.size("has") > 0).groupBy("has").applyInArrow(add, schema)


def _products(z: np.ndarray, seen: np.ndarray, others: np.ndarray) -> np.ndarray:
    """Rows that have all of a set in `others`, times what each pair of features adds for such rows: the number, and by name the product, both squares and both sums."""
    i, j = np.triu_indices(seen.shape[1], 1)
    both = seen[:, i] * seen[:, j]
    columns = [both]
    for x in z:
        u, v = x[:, i] * both, x[:, j] * both
        columns += [u * v, u * u, v * v, u, v]
    return seen[:, others].prod(2).T @ np.concatenate(columns, 1)


def _of_blocks(table: np.ndarray, blocks: np.ndarray, others: np.ndarray, features: int, names: int) -> np.ndarray:
    """A row of number, sums and products for each block, read from a summed table of `_products`: of a square or sum by the block's first feature, or its second."""
    size = blocks.shape[1]
    powers = features ** np.arange(size - 2, dtype=np.int64)
    codes = others @ powers
    order = np.argsort(codes)
    pair = np.zeros((features, features), np.int64)
    i, j = np.triu_indices(features, 1)
    pair[i, j] = np.arange(len(i))

    def read(kind: int, x: int, y: int) -> np.ndarray:
        rest = np.delete(blocks, (x, y), axis=1)
        return table[order[np.searchsorted(codes, rest @ powers, sorter=order)], kind * len(i) + pair[blocks[:, x], blocks[:, y]]]

    single = lambda k, kind, x: read(5 * k + kind + (x > 0), 0, max(x, 1))
    out = [read(0, 0, 1)]
    for k in range(names):
        out += [single(k, 4, x) for x in range(size)]
    for k in range(names):
        for x in range(size):
            out += [single(k, 2, x), *(read(5 * k + 1, x, y) for y in range(x + 1, size))]
    return np.stack(out, 1)


def _multiplied(rows: DataFrame, names: list[str], origin: np.ndarray, size: int, tasks: int, schema: str) -> DataFrame:
    """(code, v0, ...) of blocks, one row a task and block: batches of rows are products of matrices, whatever sets of features they have."""
    features = origin.shape[1]
    others = _combinations(features, size - 2)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = None
        for b in (x.slice(lo, ROWS) for x in batches for lo in range(0, len(x), ROWS)):
            x = np.stack([values_of(b.column(c), features) for c in names]) - origin[:, None]
            seen = ~np.isnan(x).any(0)
            part = _products(np.where(seen, x, 0.0), seen.astype(float), others)
            table = part if table is None else table + part
        if table is not None:
            blocks = _combinations(features, size)
            out = _of_blocks(table, blocks, others, features, len(names))
            out, blocks = out[out[:, 0] > 0], blocks[out[:, 0] > 0]
            code = blocks @ (features ** np.arange(size, dtype=np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(code), *(pa.array(v) for v in np.ascontiguousarray(out.T))], ["code", *(f"v{k}" for k in range(out.shape[1]))])

    return rows.select(*names).repartition(tasks).mapInArrow(run, schema)


def block_moments(rows: DataFrame, names: list[str], features: int, size: int) -> DataFrame:
    """(block, n, s, q) for every set of `size` features that entities have in full: `block` is the sorted places of its features, n its entities.

    `rows` has an array column for each of `names`, values in feature order. s holds, by name, the sums of the block's values, q those of the products of each two of its
    features (i <= j in row order), all from each feature's mean over the table, so that no digit is lost.

    A block is a pair of features and the others: rows that have all of the others, times what they add for a pair, are one product of matrices a batch, and a task passes on
    one row a block. Where that table would be too large, entities are summed by their set of features once, and each such set is dealt to the blocks that it holds.
    """
    rows = stored(rows.select(*names), "block-rows")
    means = rows.agg(F.count(F.lit(1)).alias("rows"), *[F.avg(F.get(c, F.lit(k))).alias(f"{c}_{k}") for c in names for k in range(features)]).first()
    origin = np.array([[means[f"{c}_{k}"] or 0.0 for k in range(features)] for c in names])
    if features**size >= 1 << 62:
        raise ValueError("too many features for blocks of this size")
    inner = [(a, b) for a in range(size) for b in range(a, size)]
    width = len(names) * (size + len(inner))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, numbers, held = [], [], 0
        for b in batches:
            for has, n, s, q in zip(*(b.column(c).to_pylist() for c in ("has", "n", "s", "q")), strict=True):
                at = np.asarray(has)
                if len(at) < size:
                    continue
                chosen = _combinations(len(at), size)
                s, q = np.reshape(s, (len(names), -1)), np.reshape(q, (len(names), len(at), len(at)))
                sums = [s[k][chosen] for k in range(len(names))]
                products = [np.stack([q[k][chosen[:, x], chosen[:, y]] for x, y in inner], 1) for k in range(len(names))]
                codes.append(at[chosen] @ (features ** np.arange(size, dtype=np.int64)))
                numbers.append(np.column_stack([np.full(len(chosen), n), *sums, *products]))
                held += len(chosen)
                if held >= HELD:
                    yield _summed(codes, numbers)
                    codes, numbers, held = [], [], 0
        if held:
            yield _summed(codes, numbers)

    columns = [f"v{k}" for k in range(width + 1)]
    schema = "code long, " + ", ".join(f"{c} double" for c in columns)
    if 2 <= size <= features and comb(features, size - 2) * comb(features, 2) * (1 + 5 * len(names)) <= PRODUCTS:
        tasks = max(1, min(means["rows"] // ROWS, 4 * rows.sparkSession.sparkContext.defaultParallelism))
        parts = _multiplied(rows, names, origin, size, tasks, schema)
    else:
        parts = _by_features(rows, names, origin).mapInArrow(run, schema)
    whole = parts.groupBy("code").agg(*[F.sum(c).alias(c) for c in columns])
    place = F.array(*[F.expr(f"cast(code div {features**k} % {features} as int)") for k in range(size)])
    cut = len(names) * size
    return whole.select(place.alias("block"), F.col("v0").cast("long").alias("n"), F.array(*columns[1 : cut + 1]).alias("s"), F.array(*columns[cut + 1 :]).alias("q"))


def _combinations(n: int, size: int) -> np.ndarray:
    return np.fromiter((k for c in combinations(range(n), size) for k in c), np.int64).reshape(comb(n, size), size)


def _summed(codes: list[np.ndarray], numbers: list[np.ndarray]) -> pa.RecordBatch:
    code, place = np.unique(np.concatenate(codes), return_inverse=True)
    every = np.concatenate(numbers)
    order = np.argsort(place, kind="stable")
    total = np.add.reduceat(every[order], np.flatnonzero(np.append(True, np.diff(place[order]) > 0)), axis=0)
    return pa.RecordBatch.from_arrays([pa.array(code), *(pa.array(v) for v in np.ascontiguousarray(total.T))], ["code", *(f"v{k}" for k in range(total.shape[1]))])


def block_correlation(name: int, names: int, size: int, a: int, b: int) -> Column:
    """The correlation of a block's a-th and b-th feature (a < b) by the name-th values, from `block_moments`; null without spread."""
    inner = {pair: k for k, pair in enumerate((x, y) for x in range(size) for y in range(x, size))}
    s = lambda k: F.get("s", F.lit(name * size + k))
    q = lambda x, y: F.get("q", F.lit(name * len(inner) + inner[x, y])) - s(x) * s(y) / F.col("n")
    return F.try_divide(q(a, b), F.sqrt(F.greatest(q(a, a), F.lit(0.0))) * F.sqrt(F.greatest(q(b, b), F.lit(0.0))))
