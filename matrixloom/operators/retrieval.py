"""Retrieval of labelled rows by a score: areas, precisions, ranks of partners."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .ranks import carried, ranged


def roc_auc(df: DataFrame, label: str, score: str, by: list[str] | None = None) -> DataFrame:
    """Area under the ROC curve, ties half; a higher score means positive. Null with one label only.

    Summed over distinct scores: positives times the negatives above them are what is lost.
    """
    by = by or []
    p, n = F.sum("p"), F.sum(F.col("c") - F.col("p"))
    lost = F.sum(F.col("p") * ((F.col("all") - F.col("tp")) - (F.col("c") - F.col("p")) / 2))
    return score_steps(df, label, score, by).groupBy(*by).agg(F.when((p > 0) & (n > 0), 1 - lost / (p * n)).alias("auc"))


def score_steps(df: DataFrame, label: str, score: str, by: list[str] | None = None) -> DataFrame:
    """(by, score, tp, all): positives and rows at or above each distinct score.

    Rows with one score are counted before the cumulative sum. Without groups distinct scores are dealt to ranges, so no task holds them all.
    """
    by = by or []
    n = df.groupBy(*by, F.col(score).alias("score")).agg(F.sum(label).alias("p"), F.count(F.lit(1)).alias("c"))
    if not by:
        order = [F.col("score").desc()]
        return carried(carried(ranged(n, by, order), by, order, "tp", F.col("p")), by, order, "all", F.col("c")).select("score", "p", "c", "tp", "all")
    w = Window.partitionBy(*by).orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, 0)
    return n.select(*by, "score", "p", "c", F.sum("p").over(w).alias("tp"), F.sum("c").over(w).alias("all"))


def average_precision(df: DataFrame, label: str, score: str, by: list[str] | None = None) -> DataFrame:
    """Average precision that steps at distinct scores."""
    by = by or []
    return score_steps(df, label, score, by).groupBy(*by).agg((F.sum(F.col("p") * F.col("tp") / F.col("all")) / F.sum("p")).alias("ap"))


def sequential_precision(df: DataFrame, label: str, score: str, position: str, by: list[str] | None = None) -> DataFrame:
    """Average precision row by row; of equal scores the later position comes first."""
    by = by or []
    seq = _in_order(df, label, score, position, by)
    return seq.groupBy(*by).agg((F.sum(F.col("y") * F.col("tp") / F.col("k")) / F.sum("y")).alias("ap"))


def _in_order(df: DataFrame, label: str, score: str, position: str, by: list[str]) -> DataFrame:
    """(by, y, k, tp): each row's place by falling score and position, and positives up to it, from ranges of rows."""
    order = [F.col("_s").desc(), F.col("_at").desc()]
    rows = ranged(df.select(*by, F.col(label).alias("y"), F.col(score).alias("_s"), F.col(position).alias("_at")), by, order)
    return carried(carried(rows, by, order, "k", F.lit(1)), by, order, "tp", F.col("y")).select(*by, "y", "k", "tp")


def precision_at_positives(df: DataFrame, label: str, score: str, position: str, by: list[str] | None = None) -> DataFrame:
    """Share of positives among as many first rows as there are positives."""
    by = by or []
    rows = _in_order(df, label, score, position, by)
    n = rows.groupBy(*by).agg(F.sum("y").alias("n"))
    return (rows.join(n, by) if by else rows.join(F.broadcast(n))).where("k <= n").groupBy(*by).agg((F.sum("y") / F.first("n")).alias("precision"))


def tied_ranks(df: DataFrame, query: str, score: str, target: str, top: int) -> DataFrame:
    """Chance that each query's target row is in the top when ties are broken at random, and its mean reciprocal rank over ties."""
    own = df.where(F.col(target) == 1).groupBy(query).agg(F.max(score).alias("own"))
    n = df.join(own, query).groupBy(query).agg(F.count_if(F.col(score) > F.col("own")).alias("above"), F.count_if(F.col(score) == F.col("own")).alias("tied"))
    chance = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (top - F.col("above")) / F.col("tied")))
    mrr = F.aggregate(F.sequence(F.col("above") + 1, F.col("above") + F.col("tied")), F.lit(0.0), lambda a, r: a + 1 / r) / F.col("tied")
    return n.select(query, "above", "tied", chance.alias("top_chance"), mrr.alias("reciprocal"))


def best_partners(pairs: DataFrame, truth: str, score: str) -> DataFrame:
    """For each item of a pair table: its true best partner's rank by another value; ties go to the lesser partner."""
    both = pairs.select(F.col("i").alias("q"), F.col("j").alias("partner"), truth, score).union(pairs.select("j", "i", truth, score))
    w = lambda c: Window.partitionBy("q").orderBy(F.desc(c), "partner")
    ranked = both.select("q", "partner", F.row_number().over(w(truth)).alias("true_rank"), F.row_number().over(w(score)).alias("rank"))
    return ranked.where("true_rank = 1").select("q", "partner", "rank", (F.col("rank") == 1).cast("int").alias("top1"), (F.col("rank") <= 3).cast("int").alias("top3"), (1 / F.col("rank")).alias("reciprocal"))


def strongest(values: np.ndarray, share: float) -> np.ndarray:
    """1 for the ceil(share * n) greatest of a pair vector, at least one, earlier pairs first among ties; else 0."""
    out = np.zeros(len(values), int)
    out[np.argsort(-values, kind="stable")[: max(1, int(np.ceil(share * len(values))))]] = 1
    return out


def pair_auc(score: np.ndarray, label: np.ndarray) -> float:
    """The chance that a positive pair has the greater score, ties half."""
    ranks = pd.Series(score).rank().to_numpy()
    p = int(label.sum())
    return float((ranks[label == 1].sum() - p * (p + 1) / 2) / (p * (len(label) - p)))
