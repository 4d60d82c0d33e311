"""Global alignment of pairs of texts: pairs of like lengths in one matrix, an anti-diagonal of all of them at a time."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: Cells of the anti-diagonals that are held at once.
CELLS = 1 << 20
#: A step's score, then its matches, then its columns weigh in one number; texts of up to 2 ** 20 characters keep them apart.
_SCORE, _MATCH = 1 << 42, 1 << 21
_NEVER = -(1 << 60)


def _codes(texts: list[str], width: int) -> np.ndarray:
    out = np.full((len(texts), width), -1, np.int64)
    for k, t in enumerate(texts):
        out[k, : len(t)] = np.frombuffer(t.encode("utf-32-le", "surrogatepass"), "<u4")
    return out


def aligned(a: list[str], b: list[str], match: int, mismatch: int, opening: int, extending: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(score, matches, columns) of the best global alignment of each pair; of equal scores the one with most matches, then with fewest columns.

    A gap of k characters scores opening + (k - 1) * extending. What is best adds up along an alignment, score first, so one number a cell holds all three and
    no path is traced back. Cells of an anti-diagonal depend on the two before it only.
    """
    la, lb = np.array([len(t) for t in a]), np.array([len(t) for t in b])
    m, n = int(la.max(initial=0)), int(lb.max(initial=0))
    x, y = _codes(a, m), _codes(b, n)
    pairs = len(a)
    step = np.array([mismatch * _SCORE - 1, match * _SCORE + _MATCH - 1])
    first, more = opening * _SCORE - 1, extending * _SCORE - 1
    never = lambda: np.full((pairs, m + 1), _NEVER)
    old, now = [never() for _ in range(3)], [never() for _ in range(3)]  # ends in a pair of characters, in a gap of b, in a gap of a
    now[0][:, 0] = 0
    out = np.where((la == 0) & (lb == 0), 0, _NEVER)
    for d in range(1, m + n + 1):
        lo, hi = max(0, d - n), min(m, d)
        new = [never() for _ in range(3)]
        down = slice(max(lo, 1), hi + 1)  # i >= 1: a character of a is spent
        up = slice(max(lo, 1) - 1, hi)
        new[1][:, down] = np.maximum(np.maximum(now[0][:, up], now[2][:, up]) + first, now[1][:, up] + more)
        across = slice(lo, min(hi, d - 1) + 1)  # j >= 1: a character of b is spent
        new[2][:, across] = np.maximum(np.maximum(now[0][:, across], now[1][:, across]) + first, now[2][:, across] + more)
        i0, i1 = max(lo, 1), min(hi, d - 1)
        if i0 <= i1:
            i = np.arange(i0, i1 + 1)
            best = np.maximum(np.maximum(old[0][:, i - 1], old[1][:, i - 1]), old[2][:, i - 1])
            new[0][:, i] = best + step[(x[:, i - 1] == y[:, d - i - 1]).astype(int)]
        for v in new:
            np.maximum(v, _NEVER, out=v)
        ends = np.flatnonzero(la + lb == d)
        out[ends] = np.max([v[ends, la[ends]] for v in new], axis=0)
        old, now = now, new
    rest = out + _SCORE // 2  # scores may be negative: the nearest multiple is the score's
    score = rest // _SCORE
    rest = out - score * _SCORE
    matches = (rest + _MATCH - 1) // _MATCH
    return score, matches, matches * _MATCH - rest


def identities(pairs: DataFrame, one: str, other: str, match: int = 1, mismatch: int = 0, opening: int = 0, extending: int = 0) -> DataFrame:
    """`pairs` with score, matches and columns of the best global alignment of two text columns, and `identity`, matches over columns (null where both texts are empty).

    Scores are integers (scale others). Null texts are empty. Pairs of an Arrow batch are aligned by like lengths, a bounded number of cells at once.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x, y = ([t or "" for t in b.column(c).to_pylist()] for c in (one, other))
            out = np.zeros((3, len(b)), np.int64)
            left = sorted(range(len(b)), key=lambda k: (len(x[k]), len(y[k])))
            while left:
                width = len(x[left[-1]]) + 1  # the longest of what is left goes with those before it
                some, left = left[-max(1, CELLS // width) :], left[: -max(1, CELLS // width)]
                out[:, some] = aligned([x[k] for k in some], [y[k] for k in some], match, mismatch, opening, extending)
            share = [int(i) / int(c) if c else None for i, c in zip(out[1], out[2])]
            yield pa.RecordBatch.from_arrays([*b.columns, *(pa.array(v) for v in out), pa.array(share, pa.float64())], [*b.schema.names, "score", "matches", "columns", "identity"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pairs.schema)
    return pairs.mapInArrow(run, kinds + ", score long, matches long, columns long, identity double")
