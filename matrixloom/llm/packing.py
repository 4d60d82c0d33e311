"""Operator 3, best-fit packing: length patterns fitted to the histogram by non-negative least squares."""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from tokenizers import Tokenizer

from .common import lean, slices, written

#: Tokens in a sequence, the id that ends a document, and documents in a fitted pattern at most.
LENGTH, END, DEPTH = 1024, 2, 3
VOCABULARY = "byte_bpe_50k.json"


@lru_cache(2)
def _encoder(path: str) -> tiktoken.Encoding:
    """A byte-level BPE tokenizer file as an encoder that returns arrays.

    The file's own library makes an object with offsets for every text; this one gives the same ids
    over three times as fast. Vocabulary, special tokens and split pattern are read from the file.
    """
    import public_tokenizers

    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    special = {x["content"]: x["id"] for x in spec["added_tokens"]}
    visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in visible]
    byte = {chr(b): b for b in visible} | {chr(256 + i): b for i, b in enumerate(hidden)}
    ranks = {bytes(byte[c] for c in t): i for t, i in spec["model"]["vocab"].items() if t not in special}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=special)


@lru_cache(2)
def _library(path: str) -> Tokenizer:
    return Tokenizer.from_file(path)


def token_ids(text: str | None, path: str) -> np.ndarray:
    """Ids of a text as the tokenizer file's library gives them by default: special strings inside texts are one id.

    Texts whose runs of white space are too long for the encoder's pattern go to that library itself.
    """
    try:
        ids = _encoder(path).encode_to_numpy(text or "", allowed_special="all")
    except ValueError:
        ids = _library(path).encode(text, add_special_tokens=False).ids
    return np.asarray(ids, np.uint32)


def pieces(docs: DataFrame, text: str = "text", path: str | None = None, length: int = LENGTH, end: int = END) -> DataFrame:
    """One row for each piece of each document: row (all columns but the text), piece, start, length, ids_crc32, batch, nth.

    A document is its ids and then `end`. Longer ones are cut from the end into pieces of `length`, so
    the first may be shorter. batch numbers a batch of rows, nth the pieces of one length in it.
    """
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path(VOCABULARY)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId()
        for number, b in enumerate(batches):
            source, piece, start, size, crc = [], [], [], [], []
            for i, t in enumerate(chain.from_iterable(slices(b.column(1)))):
                ids = np.append(token_ids(t, path), np.uint32(end)).astype("<u4")
                first = (len(ids) - 1) % length + 1
                cuts = [0, *range(first, len(ids) + 1, length)]
                for k, (lo, hi) in enumerate(zip(cuts, cuts[1:])):
                    source.append(i)
                    piece.append(k)
                    start.append(lo)
                    size.append(hi - lo)
                    crc.append(zlib.crc32(ids[lo:hi].tobytes()))
            size = np.array(size, np.int64)
            order = np.argsort(size, kind="stable")
            heads = np.flatnonzero(np.diff(size[order], prepend=-1))
            nth = np.empty(len(size), np.int64)
            nth[order] = np.arange(len(size)) - np.repeat(heads, np.diff(np.append(heads, len(size))))
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(pa.array(source, pa.int64())), *(pa.array(np.array(x, d)) for x, d in ((piece, np.int32), (start, np.int64), (size, np.int64), (crc, np.int64))),
                 pa.array(np.full(len(size), (task << 32) + number)), pa.array(nth)],
                ["row", "piece", "start", "length", "ids_crc32", "batch", "nth"],
            )

    carried = docs.drop(text)
    rows = lean(docs).select(F.struct(*[docs[f"`{c}`"] for c in carried.columns]).alias("row"), F.col(text).alias("text"))
    kinds = {"piece": T.IntegerType()} | dict.fromkeys(["start", "length", "ids_crc32", "batch", "nth"], T.LongType())
    return rows.mapInArrow(run, T.StructType([rows.schema["row"], *(T.StructField(n, k) for n, k in kinds.items())]))


def patterns(lengths: np.ndarray, full: int, depth: int = DEPTH) -> np.ndarray:
    """All multisets of one to `depth` (at most 3) of the lengths that sum to `full`: rows of lengths, 0 where fewer."""
    has = np.zeros(full + 1, bool)
    has[lengths] = True
    one = np.array([[full, 0, 0]])[: int(has[full])]
    low = lengths[2 * lengths <= full]
    low = low[has[full - low]] if depth > 1 else low[:0]
    two = np.stack([full - low, low, np.zeros_like(low)], 1)
    a, b = np.meshgrid(lengths, lengths, indexing="ij")
    rest = full - a - b
    good = (a <= b) & (b <= rest)
    good[good] = has[rest[good]]
    three = np.stack([rest[good], b[good], a[good]], 1) if depth > 2 else np.empty((0, 3), int)
    return np.concatenate([one, two, three]).astype(np.int64)


def fitted(counts: np.ndarray, pattern: np.ndarray, rounds: int = 600) -> np.ndarray:
    """Repeat counts x >= 0 of the patterns that bring their lengths nearest to the histogram in least squares.

    Accelerated projected gradient steps, scaled by each pattern's share of the columns it touches.
    """
    if not len(pattern):
        return np.zeros(0)
    real = pattern > 0
    use = np.bincount(pattern[real], minlength=len(counts)).astype(float)
    step = 1 / np.where(real, use[pattern], 0).sum(1)
    x = y = np.zeros(len(pattern))
    t, target = 1.0, counts.astype(float)
    for _ in range(rounds):
        off = -target
        for k in range(pattern.shape[1]):
            off = off + np.bincount(pattern[:, k], y, minlength=len(counts))
        off[0] = 0
        new = np.maximum(0, y - step * off[pattern].sum(1))
        later = (1 + (1 + 4 * t * t) ** 0.5) / 2
        y = np.maximum(0, new + (t - 1) / later * (new - x))
        x, t = new, later
    return x


def plan(counts: np.ndarray, full: int, depth: int = DEPTH) -> list[tuple[list[int], int]]:
    """(lengths, repeats) of sequences that hold each length as often as `counts` says.

    Fitted counts are rounded at several points and the plan of fewest sequences stands. Work and
    entries depend on `full`, not on how many pieces there are.
    """
    pattern = patterns(np.flatnonzero(counts), full, depth)
    x = fitted(counts, pattern)
    order = np.argsort(-x, kind="stable")
    tries = [_rounded(counts, full, pattern[order], np.floor(x[order] + up).astype(np.int64)) for up in (0.5, 0.25, 0.0)]
    return min(tries, key=lambda p: sum(n for _, n in p))


def _rounded(counts: np.ndarray, full: int, pattern: np.ndarray, want: np.ndarray) -> list[tuple[list[int], int]]:
    """A plan that repeats patterns as wanted, in their order and within what is left, and packs the rest by best fit.

    The rest goes longest first; equal sequences are one entry throughout.
    """
    left = counts.astype(np.int64).copy()
    out: list[tuple[list[int], int]] = []
    for row, n in zip(pattern[want > 0].tolist(), want[want > 0].tolist()):
        p = [v for v in row if v]
        can = min(n, *(int(left[v]) // p.count(v) for v in p))
        if can > 0:
            for v in p:
                left[v] -= can
            out.append((p, can))
    space: dict[int, list[tuple[list[int], int]]] = {}

    def put(p: list[int], n: int, room: int) -> None:
        if n:
            space.setdefault(room, []).append((p, n))

    for v in np.flatnonzero(left)[::-1].tolist():
        c = int(left[v])
        while c:
            fits = [r for r in space if r >= v and space[r]]
            if not fits:
                break
            room = min(fits)
            p, n = space[room].pop()
            if not space[room]:
                del space[room]
            took = min(n, c)
            put(p, n - took, room)
            put([*p, v], took, room - v)
            c -= took
        each = full // v
        put([v] * each, c // each, full - v * each)
        put([v] * (c % each), 1 if c % each else 0, full - v * (c % each))
    return out + [x for bins in space.values() for x in bins]


def slots(planned: list[tuple[list[int], int]], full: int) -> dict[int, tuple[np.ndarray, ...]]:
    """For each length: from which of its pieces on a slot of the plan holds, that slot's first sequence, and its offset."""
    by: dict[int, list[tuple[int, int, int]]] = {}
    upto: dict[int, int] = {}
    sequence = 0
    for p, n in planned:
        offset = 0
        for v in p:
            by.setdefault(v, []).append((upto.get(v, 0), sequence, offset))
            upto[v] = upto.get(v, 0) + n
            offset += v
        sequence += n
    return {v: tuple(np.array(x, np.int64) for x in zip(*rows)) for v, rows in by.items()}


def packed(docs: DataFrame, text: str = "text", path: str | None = None, length: int = LENGTH, end: int = END, depth: int = DEPTH) -> DataFrame:
    """row, piece, start, length, ids_crc32, sequence_id and offset of each piece of every row of `docs`.

    Null and empty texts are one piece of the end id. Repeated rows are packed as often as they
    occur; an empty table gives no rows. The pieces, without their ids, are written once. The driver
    gets their histogram, `length` counts at most, and returns a plan whose size depends on `length` alone. Each
    piece's number among those of its length is its number in its batch plus what earlier batches hold.
    """
    cut = written(pieces(docs, text, path, length, end), "pieces")
    held = cut.groupBy("length", "batch").agg(F.count(F.lit(1)).alias("n")).withColumn("task", F.shiftright("batch", 32))
    # counts of earlier tasks, then of earlier batches of the own task: no window holds all batches of a length
    tasks = held.groupBy("length", "task").agg(F.sum("n").alias("m"))
    tasks = tasks.select("length", "task", (F.sum("m").over(Window.partitionBy("length").orderBy("task")) - F.col("m")).alias("earlier"))
    inside = F.sum("n").over(Window.partitionBy("length", "task").orderBy("batch")) - F.col("n")
    before = held.withColumn("inside", inside).join(tasks, ["length", "task"]).select("length", "batch", (F.col("earlier") + F.col("inside")).alias("before"))
    counts = np.zeros(length + 1, np.int64)
    for size, n in cut.groupBy("length").count().collect():
        counts[size] = n
    where = slots(plan(counts, length, depth), length)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            size, nth = b.column("length").to_numpy(), b.column("number").to_numpy()
            sequence, offset = np.empty(len(size), np.int64), np.empty(len(size), np.int64)
            for v in np.unique(size).tolist():
                at = np.flatnonzero(size == v)
                begins, first, inside = where[v]
                k = np.searchsorted(begins, nth[at], side="right") - 1
                sequence[at] = first[k] + nth[at] - begins[k]
                offset[at] = inside[k]
            names = ["row", "piece", "start", "length", "ids_crc32"]
            yield pa.RecordBatch.from_arrays([*(b.column(x) for x in names), pa.array(sequence), pa.array(offset)], [*names, "sequence_id", "offset"])

    numbered = cut.join(before, ["length", "batch"]).select("row", "piece", "start", "length", "ids_crc32", (F.col("before") + F.col("nth")).alias("number"))
    kinds = {"piece": T.IntegerType()} | dict.fromkeys(["start", "length", "ids_crc32", "sequence_id", "offset"], T.LongType())
    return numbered.mapInArrow(place, T.StructType([numbered.schema["row"], *(T.StructField(n, k) for n, k in kinds.items())]))


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Place of every piece of every document in sequences of 1024 tokens; see `packed`."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return packed(docs.select("doc_id", "text")).select("row.doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
