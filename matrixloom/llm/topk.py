"""Operator 8, exact top-k search: incremental multi-index hashing over binary codes."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import discard, written

#: Neighbours of a query, and bits of a code.
K, BITS = 10, 64


def sign_code(vector: Column) -> Column:
    """A vector of up to 64 numbers as a long: bit i is set where number i is above 0; null numbers leave it clear. A null vector has none."""
    bit = lambda x, i: F.when(x > 0, F.call_function("shiftleft", F.lit(1).cast("long"), i)).otherwise(F.lit(0).cast("long"))
    return F.when(vector.isNotNull(), F.aggregate(F.transform(vector, bit), F.lit(0).cast("long"), lambda a, b: a.bitwiseOR(b)))


def segments(n: int, bits: int = BITS) -> list[tuple[int, int]]:
    """Lowest bit and width of each segment: at most log2(n) bits wide for up to 2 ** 21 codes, 3 to 8 of them."""
    m = min(8, max(3, math.ceil(bits / max(1.0, math.log2(max(n, 2))))))
    cut = [bits * i // m for i in range(m + 1)]
    return [(cut[i], cut[i + 1] - cut[i]) for i in range(m)]


def _part(code: Column, low: int, width: int) -> Column:
    return F.shiftrightunsigned(code, low).bitwiseAND(F.lit((1 << width) - 1))


def _least(rows: DataFrame, by: str, order: list[str], n: int) -> DataFrame:
    """The n least rows of each group; Spark keeps n of a group in each task before it shuffles."""
    return rows.withColumn("_nth", F.row_number().over(Window.partitionBy(by).orderBy(*order))).where(F.col("_nth") <= n).drop("_nth")


def top_k(codes: DataFrame, queries: DataFrame, k: int = K, bits: int = BITS) -> DataFrame:
    """(query_id, neighbor_id, distance, rank): the k codes nearest each query by Hamming distance, exactly.

    Both inputs have columns id and code (long). Equal distances go by smaller id; a query is no
    neighbour of its own id. Rows with a null id or code are left out; of rows with one id the least
    code stands. Fewer than k rows in all give fewer neighbours.

    Equal codes are one entry with their k + 1 least ids. Round s looks up, for each segment, all
    values at s bits from the query's, in a merge join that adaptive execution can split where a value is crowded; nothing is
    broadcast. A pair is met in the round of its nearest segment only, so none is met twice. After
    round s every code within m * (s + 1) - 1 bits is known for m segments; a query leaves when its
    (k + 1)th verified distance is within that. The driver gets counts only.
    """
    rows = codes.dropna(subset=["id", "code"]).groupBy("id").agg(F.min("code").alias("code"))
    entries = written(_least(rows, "code", ["id"], k + 1).groupBy("code").agg(F.collect_list("id").alias("ids")), "topk-index")
    asked = written(queries.dropna(subset=["id", "code"]).groupBy("id").agg(F.min("code").alias("code")), "topk-queries")
    seg = segments(entries.count(), bits)
    parts = F.array(*[F.struct(F.lit(i).alias("seg"), _part(F.col("code"), *s).alias("value")) for i, s in enumerate(seg)])
    index = entries.select("code", "ids", F.explode(parts).alias("p")).select("code", "ids", "p.seg", "p.value")
    active = written(asked.select("code").distinct().select(F.col("code").alias("q"), F.lit(bits).alias("bound")), "topk-active")
    best = None
    for s in range(max(w for _, w in seg) + 1):
        found = _round(active, index, seg, s)
        old, best = best, written(_least(found if best is None else best.unionByName(found), "q", ["distance", "id"], k + 1), "topk-best")
        if old is not None:
            discard(old)
        covered = len(seg) * (s + 1) - 1
        reach = best.groupBy("q").agg(F.count(F.lit(1)).alias("n"), F.max("distance").alias("worst"))
        bound = F.when(F.col("n") > k, F.col("worst")).otherwise(F.lit(bits))
        left = active.select("q").join(reach, "q", "left").select("q", F.coalesce(bound, F.lit(bits)).alias("bound")).where(F.col("bound") > covered)
        old, active = active, written(left, "topk-active")
        discard(old)
        if active.isEmpty():
            break
    hits = asked.select(F.col("id").alias("query_id"), F.col("code").alias("q")).join(best, "q").where("query_id <> id")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("distance", "id"))
    return hits.select("query_id", F.col("id").alias("neighbor_id"), "distance", rank.cast("int").alias("rank")).where(F.col("rank") <= k)


def _round(active: DataFrame, index: DataFrame, seg: list[tuple[int, int]], s: int) -> DataFrame:
    """(q, distance, id) of codes whose nearest segment is s bits from the query's, within the query's bound."""
    q = F.col("q")
    met = _probes(active, seg, s).hint("merge").join(index, ["seg", "value"])
    differ = q.bitwiseXOR(F.col("code"))
    near = [F.bit_count(_part(differ, *at)) for at in seg]
    first = F.lit(True)
    for j, d in enumerate(near):
        first = first & F.when(F.col("seg") > j, d > s).otherwise(d >= s)
    return met.where(first).select("q", "ids", F.bit_count(differ).alias("distance"), "bound").where("distance <= bound").select("q", "distance", F.explode("ids").alias("id"))


def _probes(active: DataFrame, seg: list[tuple[int, int]], s: int) -> DataFrame:
    """(q, bound, seg, value): every value at s bits from each segment of the queries' codes; a step sets one more bit above the last."""
    places = F.array(*[F.struct(F.lit(i).alias("seg"), F.lit(width).alias("width"), _part(F.col("q"), low, width).alias("value")) for i, (low, width) in enumerate(seg) if s <= width])
    spread = active.repartition(2 * active.sparkSession.sparkContext.defaultParallelism, "q")  # a few queries make many probes
    out = spread.select("q", "bound", F.explode(places).alias("p")).select("q", "bound", "p.seg", "p.width", "p.value", F.lit(-1).alias("last"))
    for step in range(1, s + 1):
        out = out.withColumn("last", F.explode(F.sequence(F.col("last") + 1, F.col("width") - (s - step + 1))))
        out = out.withColumn("value", F.col("value").bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), F.col("last"))))
    return out.select("q", "bound", "seg", "value")


def op8_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Queries: every row whose vec_id is divisible by 100, against all rows."""
    codes = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.col("vec_id").alias("id"), sign_code(F.col("embedding")).alias("code"))
    codes = written(codes, "topk-codes")
    return top_k(codes, codes.where("id % 100 = 0"))


OP8_SQL = f"""
WITH v AS (SELECT vec_id, array_to_string([CASE WHEN x > 0 THEN '1' ELSE '0' END FOR x IN embedding], '') AS code FROM embeddings),
near AS (
  SELECT q.vec_id AS query_id, v.vec_id AS neighbor_id, hamming(q.code, v.code)::INTEGER AS distance,
         (row_number() OVER (PARTITION BY q.vec_id ORDER BY hamming(q.code, v.code), v.vec_id))::INTEGER AS rank
  FROM v AS q JOIN v ON v.vec_id <> q.vec_id WHERE q.vec_id % 100 = 0)
SELECT query_id, neighbor_id, distance, rank FROM near WHERE rank <= {K}
"""
