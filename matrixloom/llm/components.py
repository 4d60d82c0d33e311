"""Connected components of an edge table by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, written

#: Edges that a file holds at most on average.
FILE_ROWS = 200_000


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): the smallest node that each node of an edge table reaches.

    Loops and repeated edges are allowed, null ends are ignored, an empty table gives an empty one.
    Each round is two joins and aggregations on the edges; only a count and a checksum come to the
    driver. Rounds grow with the logarithm of the largest component. A round makes no more edges than it is given nodes for, so
    few edges are written to few files.
    """
    now = written(
        edges.where(f"{a} <> {b}").select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct(), "edges"
    )
    seen = _mark(now)
    while True:
        old, now = now, written(_small_star(_large_star(now)).coalesce(max(1, -(-seen[0] // FILE_ROWS))), "edges")
        discard(old)
        mark = _mark(now)
        if mark == seen:
            break
        seen = mark
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.xxhash64("v", "u") % 1000003)).first())


def _large_star(edges: DataFrame) -> DataFrame:
    """Links each larger neighbour of a node to the least of the node and its neighbours."""
    both = edges.select("u", "v").union(edges.select("v", "u"))
    least = both.groupBy("u").agg(F.min("v").alias("low")).select(F.col("u").alias("of"), F.least("u", "low").alias("low"))
    return both.join(least, F.col("u") == F.col("of")).where("v > u").select(F.col("v").alias("u"), F.col("low").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Links a node and its smaller neighbours to the least of those neighbours."""
    least = edges.groupBy("u").agg(F.min("v").alias("low")).select(F.col("u").alias("of"), "low")
    moved = edges.join(least, F.col("u") == F.col("of")).where("v > low").select(F.col("v").alias("u"), F.col("low").alias("v"))
    return moved.union(least.select("of", "low")).distinct()
