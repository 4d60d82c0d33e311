"""Operator 4, toxicity: a linear classifier over character n-grams scaled by naive Bayes log-count ratios."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import lean, mixed, slices, written

#: Characters of n-grams, bits of their hash, and features that the classifier keeps.
GRAMS, HASH_BITS, FEATURES = (3, 4, 5, 6), 20, 2048
#: Labelled rows that the classifier is fitted on at most: those of least hash of the id.
SAMPLE = 20_000
#: Score from which a text is predicted toxic; a remainder of crc32(id as text) modulo 4 that is held out.
THRESHOLD, FOLDS, HELD_OUT = 0.3, 4, 2
#: Characters of texts that are hashed together.
BLOCK = 1 << 20


def gram_hits(texts: list[str | None], feature: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (text, feature) pairs of lower-cased texts, by text. `feature` maps hashes to features, -1 to none; else hashes count."""
    data = [(t or "").lower() for t in texts]
    buf = np.frombuffer("\n".join(data).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    begin = np.cumsum([0, *(len(t) + 1 for t in data)])
    found = []
    summed = np.zeros(len(buf), np.uint64)
    for n in range(1, max(GRAMS) + 1):
        if len(buf) < n:
            break
        summed = summed[: len(buf) - n + 1] * np.uint64(0x100000001B3) + buf[n - 1 :]
        if n in GRAMS:
            h = (mixed(summed, n) >> np.uint64(64 - HASH_BITS)).astype(np.int64)
            ids = h if feature is None else feature[h]
            at = np.arange(len(ids)) if feature is None else np.flatnonzero(ids >= 0)
            whose = np.searchsorted(begin, at, side="right") - 1
            inside = at + n < begin[whose + 1]
            found.append((whose[inside] << 32) | ids[at[inside]])
    pairs = np.unique(np.concatenate(found)) if found else np.empty(0, np.int64)
    return pairs >> 32, pairs & 0xFFFFFFFF


def _blocks(texts: list[str | None]) -> Iterator[tuple[int, int]]:
    lo = 0
    while lo < len(texts):
        hi, held = lo, 0
        while hi < len(texts) and (hi == lo or held + len(texts[hi] or "") <= BLOCK):
            held += len(texts[hi] or "")
            hi += 1
        yield lo, hi
        lo = hi


@dataclass(frozen=True)
class Model:
    """Feature number by hash (-1: none), weight of each feature, and the intercept."""

    feature: np.ndarray
    weight: np.ndarray
    bias: float

    def scores(self, texts: list[str | None]) -> np.ndarray:
        """Probability that each text is toxic; null and empty ones get the intercept's."""
        out = np.full(len(texts), self.bias)
        for lo, hi in _blocks(texts):
            whose, what = gram_hits(texts[lo:hi], self.feature)
            out[lo:hi] += np.bincount(whose, self.weight[what], minlength=hi - lo)
        return 1 / (1 + np.exp(-np.clip(out, -500, 500)))


def _counts(sample: DataFrame) -> DataFrame:
    """(feature, toxic, clean): in how many sampled texts of either label each hash occurs; a task adds up its own first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros((2, 1 << HASH_BITS), np.int64)
        for b in batches:
            texts, toxic = b.column("text").to_pylist(), b.column("toxic").to_numpy()
            for lo, hi in _blocks(texts):
                whose, what = gram_hits(texts[lo:hi])
                for label in (0, 1):
                    n[label] += np.bincount(what[toxic[lo:hi][whose] == label], minlength=1 << HASH_BITS)
        at = np.flatnonzero(n.any(0))
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(n[1][at]), pa.array(n[0][at])], ["feature", "toxic", "clean"])

    each = sample.mapInArrow(run, "feature long, toxic long, clean long")
    return each.groupBy("feature").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))


def _chosen(counts: DataFrame, toxic: int, clean: int) -> list:
    """The features whose log-count ratios lie most standard errors from 0, with their ratios."""
    ratio = F.log((F.col("toxic") + 1) / (toxic + 2)) - F.log((F.col("clean") + 1) / (clean + 2))
    error = F.sqrt(1 / (F.col("toxic") + 1) + 1 / (F.col("clean") + 1))
    return counts.select("feature", ratio.alias("ratio"), F.abs(ratio / error).alias("z")).orderBy(F.desc("z"), "feature").limit(FEATURES).collect()


def fit(labelled: DataFrame, text: str = "text", label: str = "toxic", key: str = "doc_id", sample: int = SAMPLE, rounds: int = 400, ridge: float = 1e-3) -> Model:
    """Fits the classifier on labelled rows: `sample` of them at most, those of least hash of the key, then of the text. Equal rows count once, so copies of a key can't raise the bound.

    Rows with a null label are left out, null texts count as empty. With no labelled rows every score is 0.5.
    The driver gets the chosen features and the sampled rows' hits on them, both bounded by the parameters.
    """
    used = lean(labelled).dropna(subset=[label]).select(F.col(text).alias("text"), F.col(label).cast("int").alias("toxic"), F.struct(F.xxhash64(key).alias("k"), F.xxhash64(text).alias("t")).alias("h"))
    # hashes alone find the bound, so that no task gathers texts
    bound = used.select("h", "toxic").distinct().orderBy("h", "toxic").limit(sample).agg(F.max(F.struct("h", "toxic")).alias("b")).first()["b"]
    last = bound and F.struct(F.struct(F.lit(bound.h.k).cast("long").alias("k"), F.lit(bound.h.t).cast("long").alias("t")).alias("h"), F.lit(bound.toxic).alias("toxic"))
    inside = F.lit(False) if bound is None else F.struct("h", "toxic") <= last
    kept = written(used.where(inside).groupBy("h", "toxic").agg(F.min("text").alias("text")).select("text", "toxic"), "toxicity-sample")
    size = {r["toxic"]: r["count"] for r in kept.groupBy("toxic").count().collect()}
    rows = _chosen(_counts(kept), size.get(1, 0), size.get(0, 0))
    feature = np.full(1 << HASH_BITS, -1, np.int32)
    feature[[r["feature"] for r in rows]] = np.arange(len(rows))
    ratio = np.array([r["ratio"] for r in rows])

    def hits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column("text").to_pylist()
            got = [np.empty(0, np.uint16)] * len(texts)
            for lo, hi in _blocks(texts):
                whose, what = gram_hits(texts[lo:hi], feature)
                cut = np.searchsorted(whose, np.arange(hi - lo + 1))
                got[lo:hi] = [what[a:z].astype(np.uint16) for a, z in zip(cut, cut[1:])]
            yield pa.RecordBatch.from_arrays([b.column("toxic"), pa.array([x.tobytes() for x in got], pa.binary())], ["toxic", "hits"])

    seen = kept.mapInArrow(hits, "toxic int, hits binary").toArrow()
    label = seen.column("toxic").to_numpy().astype(float)
    each = [np.frombuffer(x, np.uint16) for x in seen.column("hits").to_pylist()]
    row = np.repeat(np.arange(len(each)), [len(x) for x in each])
    column = np.concatenate([*each, np.empty(0, np.uint16)]).astype(np.int64)
    weight, bias = _logistic(row, column, ratio[column], label, len(rows), rounds, ridge)
    return Model(feature, weight * ratio, bias)


def _logistic(row: np.ndarray, column: np.ndarray, value: np.ndarray, label: np.ndarray, features: int, rounds: int, ridge: float) -> tuple[np.ndarray, float]:
    """Ridge logistic regression on sparse rows by accelerated gradient steps, each scaled by its column."""
    n = len(label)
    if not n:
        return np.zeros(features), 0.0
    share = float(np.clip(label.mean(), 1e-3, 1 - 1e-3))
    bias = float(np.log(share / (1 - share)))
    w = v = np.zeros(features)
    b = c = bias
    # a bound on the curvature: each row's sum of squares spread over its columns
    widest = np.bincount(row, np.abs(value), minlength=n)
    step = 1 / (np.bincount(column, np.abs(value) * widest[row], minlength=features) / (4 * n) + ridge + 1e-9)
    for t in range(1, rounds + 1):
        p = 1 / (1 + np.exp(-np.clip(np.bincount(row, value * v[column], minlength=n) + c, -500, 500)))
        off = (p - label) / n
        new = v - step * (np.bincount(column, value * off[row], minlength=features) + ridge * v)
        new_b = c - 2 * off.sum()
        pull = (t - 1) / (t + 2)
        v, c = new + pull * (new - w), new_b + pull * (new_b - b)
        w, b = new, new_b
    return w, float(b)


def held_out(key: Column) -> Column:
    return F.crc32(key.cast("string").cast("binary")) % FOLDS == HELD_OUT


def scored(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """key, score (0 to 1) and predicted of every row; the text alone decides. Null texts count as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            scores = np.concatenate([np.empty(0), *map(model.scores, slices(b.column(1)))])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(scores)], [key, "score"])

    out = lean(docs).select(key, text).mapInArrow(run, f"`{key}` {docs.schema[key].dataType.simpleString()}, score double")
    return out.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score of every document by the classifier that is fitted on labelled rows outside the held-out remainder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(~held_out(F.col("doc_id")))
    known = labels.dropna(subset=["doc_id", "toxic"]).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    # SAMPLE rows at most, so they can be broadcast whatever the size of the tables
    some = F.broadcast(written(known.orderBy(F.xxhash64("doc_id")).limit(SAMPLE), "toxicity-labels"))
    model = fit(docs.join(some, "doc_id"))
    out = scored(docs, model)
    return out.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "score", "predicted")
