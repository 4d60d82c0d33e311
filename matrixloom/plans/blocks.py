"""Queries: dense blocks, drawn supports, components of a total, bases side by side, refits and random subspaces."""

from __future__ import annotations

from itertools import combinations

import numpy as np
from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import cells as C
from ..operators import dense_blocks
from ..operators import geometry as G
from ..operators import regress as D
from ..operators import resample as B
from ..operators import retrieval as T
from ..sources.tables import stored, table
from .base import BRANDS, PRICED_SQL, priced, query, uniform_sql
from .inference import _two
from .matrices import _pairs, _rounded
from .wider import _brand_pairs

#: Brands of a block, and the suppliers that must have all of them.
BLOCK, LEAST = 5, 12
_AT = list(combinations(range(BLOCK), 2))
_TABLES = [f"t{k}" for k in range(BLOCK)]
_CHAIN = " ".join(f"JOIN c {b} ON {a}.entity = {b}.entity AND {a}.feature < {b}.feature" for a, b in zip(_TABLES, _TABLES[1:]))
_CORR = lambda v: "[" + ", ".join(f"round(corr(t{i}.{v}, t{j}.{v}), 9)" for i, j in _AT) + "]"


@query("t12_dense_blocks", f"""WITH c AS (SELECT l_suppkey AS entity, p_brand AS feature, round(ln(avg(l_extendedprice)), 9) AS value, round(avg(l_discount), 8) AS score FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_quantity > 48 GROUP BY 1, 2),
b AS (SELECT {" || ' ' || ".join(f"{t}.feature" for t in _TABLES)} AS block, count(*) AS n, {_CORR("value")} AS r, {_CORR("score")} AS s FROM c t0 {_CHAIN} GROUP BY 1 HAVING count(*) >= {LEAST}),
o AS (SELECT block, n, s, list_extract(s, list_position(r, list_max(r))) AS own FROM b) SELECT block, n, round(list_sum([CASE WHEN x < own THEN 1.0 WHEN x = own THEN 0.5 ELSE 0.0 END FOR x IN s]) / {len(_AT) - 1} - {0.5 / (len(_AT) - 1)}, 8) AS auc FROM o""")
def t12(spark, d):
    """Every set of five brands that enough suppliers sell together: how another score finds the pair of greatest correlation."""
    lines = table(spark, d, "lineitem").where("l_quantity > 48").select("l_suppkey", F.col("l_partkey").alias("p_partkey"), "l_extendedprice", "l_discount")
    c = lines.join(table(spark, d, "part").select("p_partkey", "p_brand"), "p_partkey").groupBy(F.col("l_suppkey").alias("entity"), F.col("p_brand").alias("feature"))
    cells = stored(c.agg(F.round(F.log(F.avg("l_extendedprice")), 9).alias("value"), F.round(F.avg("l_discount"), 8).alias("score")), "block-cells")
    x = G.rows_of(cells, BRANDS).withColumnRenamed("x", "value").join(G.rows_of(cells.select("entity", "feature", F.col("score").alias("value")), BRANDS).withColumnRenamed("x", "score"), "entity")
    m = dense_blocks.block_moments(x, ["value", "score"], len(BRANDS), BLOCK).where(F.col("n") >= LEAST)
    r = lambda k: F.array(*[F.round(dense_blocks.block_correlation(k, 2, BLOCK, i, j), 9) for i, j in _AT])
    names = F.array_join(F.transform("block", lambda k: F.get(F.array(*map(F.lit, BRANDS)), k)), " ")
    b = m.select(names.alias("block"), "n", r(0).alias("r"), r(1).alias("s"))
    own = F.element_at("s", F.array_position("r", F.array_max("r")).cast("int"))
    below = F.aggregate("s", F.lit(0.0), lambda a, s: a + F.when(s < F.col("own"), 1.0).when(s == F.col("own"), 0.5).otherwise(0.0))
    return b.withColumn("own", own).select("block", "n", F.round((below - 0.5) / (len(_AT) - 1), 8).alias("auc"))


@query("t09_drawn_supports", f"""WITH {PRICED_SQL}, c AS (SELECT replicate, p.* FROM priced p CROSS JOIN (SELECT unnest(range(10)) AS replicate) WHERE {uniform_sql("'61'", 'replicate', 'entity')} < 0.5),
e AS (SELECT a.replicate, a.feature AS i, b.feature AS j, round(corr(a.value, b.value), 8) AS r FROM c a JOIN c b ON a.replicate = b.replicate AND a.entity = b.entity AND a.feature < b.feature GROUP BY 1, 2, 3),
s AS (SELECT i, j, round(r, 8) AS s FROM ({_pairs('priced', 'score')})), y AS (SELECT replicate, s, (row_number() OVER (PARTITION BY replicate ORDER BY r DESC, i, j) <= 60)::INTEGER AS y FROM e JOIN s USING (i, j)),
k AS (SELECT replicate, y, rank() OVER (PARTITION BY replicate ORDER BY s) + (count(*) OVER (PARTITION BY replicate, s) - 1) / 2.0 AS k FROM y) SELECT replicate::INTEGER AS replicate, round((sum(k * y) - sum(y) * (sum(y) + 1) / 2) / (sum(y) * (count(*) - sum(y))), 8) AS auc FROM k GROUP BY 1""")
def t09(spark, d):
    """How a fixed score finds the strongest fifth of pairs, where that is labelled anew in each of ten halves of the suppliers."""
    cells = priced(spark, d)
    drawn = cells.withColumn("replicate", F.explode(F.sequence(F.lit(0), F.lit(9)))).where(B.uniform(61, F.col("replicate"), F.col("entity")) < 0.5)
    e = _brand_pairs(drawn.select("entity", "feature", "value", "replicate"), ["replicate"]).withColumn("r", F.round("r", 8))
    s = _brand_pairs(cells.select("entity", "feature", F.col("score").alias("value"))).select("i", "j", F.round("r", 8).alias("s"))
    place = F.row_number().over(Window.partitionBy("replicate").orderBy(F.desc("r"), "i", "j"))
    labelled = e.join(F.broadcast(s), ["i", "j"]).select("replicate", "s", (place <= 60).cast("int").alias("y"))
    return _rounded(T.roc_auc(labelled, "y", "s", ["replicate"]), 8, "auc")


_PARTS = "c AS (SELECT l_suppkey AS entity, p_brand AS feature, avg(l_extendedprice) AS total, avg(l_extendedprice * (1 - l_discount)) AS net, avg(l_extendedprice * l_discount) AS cut FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2)"


def _parts(spark, d):
    lines = table(spark, d, "lineitem").select("l_suppkey", F.col("l_partkey").alias("p_partkey"), F.col("l_extendedprice").alias("total"), (F.col("l_extendedprice") * F.col("l_discount")).alias("cut"))
    g = lines.join(table(spark, d, "part").select("p_partkey", "p_brand"), "p_partkey").groupBy(F.col("l_suppkey").alias("entity"), F.col("p_brand").alias("feature"))
    return g.agg(F.avg("total").alias("total"), F.avg(F.col("total") - F.col("cut")).alias("net"), F.avg("cut").alias("cut"))


@query("g23_row_shares", f"WITH {_PARTS}, m AS (SELECT entity, avg(total) AS t, avg(net) AS net, avg(cut) AS cut FROM c GROUP BY 1) SELECT round(covar_samp(net, t) / var_samp(t), 8) AS net, round(covar_samp(cut, t) / var_samp(t), 8) AS cut FROM m")
def g23(spark, d):
    """The share of each component in how suppliers' mean totals vary."""
    m = _parts(spark, d).groupBy("entity").agg(F.avg("total").alias("t"), F.avg("net").alias("net"), F.avg("cut").alias("cut"))
    return m.agg(*[F.round(F.covar_samp(c, "t") / F.var_samp("t"), 8).alias(c) for c in ("net", "cut")])


@query("g23_mode_shares")
def g23_modes(spark, d):
    """The share of each component in the first mode of totals, over suppliers with all brands, features scaled by the totals' deviations."""
    c = _parts(spark, d)
    full = C.complete_cases(c.withColumnRenamed("total", "value"), len(BRANDS))
    axis = G.leading_axis(G.matrix(G.correlations(full, BRANDS), len(BRANDS)))[0]
    loading = F.create_map(*[x for b, v in zip(BRANDS, axis) for x in (F.lit(b), F.lit(float(v)))])
    scale = full.groupBy("feature").agg((loading[F.col("feature")] / F.stddev_samp("value")).alias("w"))
    t = full.join(F.broadcast(scale), "feature").groupBy("entity").agg(*[F.sum(F.col(k) * F.col("w")).alias(k) for k in ("value", "net", "cut")])
    return t.agg(*[(F.covar_samp(k, "value") / F.var_samp("value")).alias(k) for k in ("net", "cut")])


#: Sets of two predictors that are compared on the same folds.
BASES = {"sizes": ["l_quantity", "l_discount"], "terms": ["l_tax", "l_linenumber"], "mixed": ["l_quantity", "l_tax"]}
_EACH = " UNION ALL ".join(f"SELECT '{b}' AS basis, l_suppkey % 5 AS fold, l_extendedprice::DOUBLE AS y, {u}::DOUBLE AS u, {v}::DOUBLE AS v FROM lineitem" for b, (u, v) in BASES.items())


@query("d05_bases", f"""WITH x AS ({_EACH}), m AS (SELECT basis, f, avg(u) AS mu, avg(v) AS mv, avg(y) AS my, var_samp(u) AS uu, var_samp(v) AS vv, covar_samp(u, v) AS uv, covar_samp(u, y) AS uy, covar_samp(v, y) AS vy FROM x JOIN (SELECT unnest(range(5)) AS f) ON fold <> f GROUP BY 1, 2),
b AS (SELECT *, (vv * uy - uv * vy) / (uu * vv - uv * uv) AS bu, (uu * vy - uv * uy) / (uu * vv - uv * uv) AS bv FROM m), p AS (SELECT x.basis, y, my + bu * (u - mu) + bv * (v - mv) AS p, avg(y) OVER (PARTITION BY x.basis) AS mean FROM x JOIN b ON b.basis = x.basis AND f = fold)
SELECT basis, round(1 - sum((y - p) ** 2) / sum((y - mean) ** 2), 6) AS r2 FROM p GROUP BY 1""")
def d05(spark, d):
    """Out-of-fold R2 of price by each basis, folds by supplier."""
    used = sorted({c for x in BASES.values() for c in x})
    rows = table(spark, d, "lineitem").select(F.col("l_extendedprice").alias("y"), *used, (F.col("l_suppkey") % 5).alias("fold"))
    return spark.createDataFrame([(b, round(r, 6)) for b, r in D.bases_r2(rows, BASES, "y", "fold").items()], "basis string, r2 double")


@query("n09_refitted")
def n09(spark, d):
    """What one matrix adds to the degrees of another in a model of it, with model and gate fitted anew for every relabelling."""
    y, x = _two(spark, d)
    degree = np.abs(y).sum(axis=0) - 1
    return B.tail(B.refit_relabelled(spark, y, x, degree[:, None] + degree[None, :], 200, 62, [0.1, 0.2, 0.3], [0.0, 0.25, 0.5]), "gain")


@query("n16_matched_subspaces")
def n16(spark, d):
    """How three modes of one matrix find the strongest fifth of pairs of another, against random axes with the same eigenvalues."""
    a, b = _two(spark, d)
    return B.tail(B.matched_subspaces(spark, a, 3, T.strongest(b[np.triu_indices(len(b), 1)], 0.2), 200, 63), "auc")
