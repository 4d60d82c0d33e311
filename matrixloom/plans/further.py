"""Queries: panels, families, more nulls and bootstraps, models and selection."""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import geometry as G
from ..operators import moments as S
from ..operators import ranking as R
from ..operators import ranks as W
from ..operators import regress as D
from ..operators import resample as B
from ..operators import retrieval as T
from ..operators import surfaces as M
from ..sources.tables import stored, table
from .base import BRANDS, DENSE, DENSE_SQL, PRICED_SQL, SPARSE_SQL, dense, dense_rows, priced, query, rank_sql, sparse, uniform_sql
from .inference import _two
from .matrices import _pairs, _rounded

_ONE = "SELECT a.{g} AS {g}, a.feature AS i, b.feature AS j, corr(a.value, b.value) AS r FROM {t} a JOIN {t} b ON a.entity = b.entity AND a.feature < b.feature GROUP BY 1, 2, 3"


@query("g15_feature_panels")
def g15(spark, d):
    """Participation ratio of random panels of features, from one correlation matrix."""
    m = G.matrix(G.correlations(dense(spark, d), DENSE), 64)

    def draw(r):
        rng = np.random.default_rng([21, r])
        size = (8, 16, 32)[r % 3]
        at = np.sort(rng.choice(64, size, replace=False))
        return {"size": float(size), "pr": float(size**2 / (m[np.ix_(at, at)] ** 2).sum())}

    return B.interval(B.replicates(spark, 90, draw, ["size", "pr"]), "pr", ["size"])


@query("g19_change_direction", f"""WITH {PRICED_SQL}, c AS (SELECT (entity % 4)::INTEGER AS part, p.* FROM priced p), e AS ({_ONE.format(g='part', t='c')}),
x AS (SELECT i, j, max(r) FILTER (WHERE part = 1) - max(r) FILTER (WHERE part = 0) AS u, max(r) FILTER (WHERE part = 3) - max(r) FILTER (WHERE part = 2) AS v FROM e GROUP BY 1, 2) SELECT round(corr(u, v), 6) + 0.0 AS r, round(avg((sign(u) = sign(v))::INTEGER), 8) AS agreement FROM x""")
def g19(spark, d):
    e = G.correlations(priced(spark, d).withColumn("part", (F.col("entity") % 4).cast("int")), BRANDS, ["part"])
    at = lambda k: F.max(F.when(F.col("part") == k, F.col("r")))
    x = e.groupBy("i", "j").agg((at(1) - at(0)).alias("u"), (at(3) - at(2)).alias("v"))
    return x.agg((F.round(F.corr("u", "v"), 6) + 0.0).alias("r"), F.round(F.avg((F.sign("u") == F.sign("v")).cast("int")), 8).alias("agreement"))


@query("g33_representation_ratios", f"""WITH {PRICED_SQL}, rc AS (SELECT entity, feature, value - avg(value) OVER (PARTITION BY entity) AS value FROM priced), p AS (SELECT 'raw' AS surface, * FROM ({_pairs('priced')}) UNION ALL SELECT 'row_centred', * FROM ({_pairs('rc')}))
SELECT surface, round(625.0 / (25 + 2 * sum(r * r)), 6) AS pr FROM p GROUP BY 1""")
def g33(spark, d):
    e = G.correlations(M.named(priced(spark, d), ["raw", "row_centred"]), BRANDS, ["surface"])
    return G.participation(e, 25, ["surface"]).select("surface", F.round("pr", 6).alias("pr"))


@query("w22_jaccard", "WITH s AS (SELECT DISTINCT p_brand AS k, l_suppkey AS p FROM lineitem JOIN part ON p_partkey = l_partkey), n AS (SELECT k, count(*) AS n FROM s GROUP BY 1), x AS (SELECT a.k AS one, b.k AS other, count(*) AS s FROM s a JOIN s b ON a.p = b.p AND a.k < b.k GROUP BY 1, 2) SELECT one, other, round(s / (u.n + v.n - s), 8) AS jaccard FROM x JOIN n u ON u.k = one JOIN n v ON v.k = other")
def w22(spark, d):
    """The index of all pairs of brands by the suppliers that sell them."""
    parts = table(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_brand").alias("k"))
    return _jaccard(table(spark, d, "lineitem").select("l_partkey", F.col("l_suppkey").alias("p")).join(parts, "l_partkey").select("k", "p").distinct())


@query("w22_jaccard_all", "WITH s AS (SELECT DISTINCT l_suppkey AS k, l_partkey AS p FROM lineitem), n AS (SELECT k, count(*) AS n FROM s GROUP BY 1), x AS (SELECT a.k AS one, b.k AS other, count(*) AS s FROM s a JOIN s b ON a.p = b.p AND a.k < b.k GROUP BY 1, 2) SELECT one, other, round(s / (u.n + v.n - s), 8) AS jaccard FROM x JOIN n u ON u.k = one JOIN n v ON v.k = other")
def w22_all(spark, d):
    """The index of all pairs of suppliers that share a part, whatever their ids."""
    return _jaccard(table(spark, d, "lineitem").select(F.col("l_suppkey").alias("k"), F.col("l_partkey").alias("p")).distinct())


def _jaccard(s):
    either = F.col("one_items") + F.col("other_items") - F.col("n")
    return W.met_pairs(s, "k", "p").select("one", "other", F.round(F.col("n") / either, 8).alias("jaccard"))


@query("r12_same_family_pairs", f"WITH {PRICED_SQL}, p AS (SELECT a.entity, a.measured - b.measured AS dm, a.score - b.score AS ds FROM priced a JOIN priced b ON a.entity = b.entity AND a.feature < b.feature AND right(a.feature, 1) = right(b.feature, 1)), e AS (SELECT entity, avg(CASE WHEN ds = 0 THEN 0.5 WHEN sign(dm) <> sign(ds) THEN 1.0 ELSE 0.0 END) AS m FROM p WHERE dm <> 0 GROUP BY 1) SELECT round(avg(m), 8) AS by_entity, count(*) AS entities FROM e")
def r12(spark, d):
    p = R.entity_pairs(priced(spark, d), ["measured", "score"]).where(F.substring("x_feature", -1, 1) == F.substring("y_feature", -1, 1))
    return R.concordance(p, "measured", "score").select(F.round("by_entity", 8).alias("by_entity"), "entities")


@query("r14_multi_target_metrics", f"WITH {PRICED_SQL}, f AS (SELECT entity, feature, value, (sum(value) OVER w - value) / (count(*) OVER w - 1) AS p, avg(value) OVER w AS m FROM priced WINDOW w AS (PARTITION BY feature)) SELECT round(1 - sum((value - p) ** 2) / sum((value - m) ** 2), 8) AS r2, round(sqrt(avg((value - p) ** 2)), 8) AS rmse FROM f")
def r14(spark, d):
    x = R.without_self(priced(spark, d))
    m = x.groupBy("feature").agg(F.avg("value").alias("m"))
    e, s = F.col("value") - F.col("others"), F.col("value") - F.col("m")
    return x.join(m, "feature").agg(F.round(1 - F.sum(e * e) / F.sum(s * s), 8).alias("r2"), F.round(F.sqrt(F.avg(e * e)), 8).alias("rmse"))


@query("t07_relabelled_retrieval", f"""WITH x AS (SELECT doc_id, n_chars AS score, toxic FROM documents JOIN labels USING (doc_id)), d AS (SELECT replicate, score, ({uniform_sql("'31'", 'replicate', 'doc_id')} < (SELECT avg(toxic) FROM x))::INTEGER AS y FROM x CROSS JOIN (SELECT unnest(range(1, 21)) AS replicate)),
k AS (SELECT replicate, y, rank() OVER (PARTITION BY replicate ORDER BY score) + (count(*) OVER (PARTITION BY replicate, score) - 1) / 2.0 AS k FROM d) SELECT replicate::INTEGER AS replicate, round((sum(k * y) - sum(y) * (sum(y) + 1) / 2) / (sum(y) * (count(*) - sum(y))), 8) AS auc FROM k GROUP BY 1""")
def t07(spark, d):
    """AUC of many label vectors drawn at the observed rate over one score; rows meet as counts of distinct scores only."""
    x = table(spark, d, "documents").select("doc_id", F.col("n_chars").alias("score")).join(table(spark, d, "labels").select("doc_id", "toxic"), "doc_id")
    rate = x.agg(F.avg("toxic").alias("rate"))
    each = x.join(rate).withColumn("replicate", F.explode(F.sequence(F.lit(1), F.lit(20))))
    drawn = each.withColumn("y", (B.uniform(31, F.col("replicate"), F.col("doc_id")) < F.col("rate")).cast("int"))
    return _rounded(T.roc_auc(drawn, "y", "score", ["replicate"]), 8, "auc")


@query("n02_paired_difference")
def n02(spark, d):
    """Correlation with raw less that with absolute geometry, both under the same relabelling."""
    a, b = _two(spark, d)
    x, y = B.relabelled(spark, a, b, 100, 22), B.relabelled(spark, np.abs(a), b, 100, 22).withColumnRenamed("rho", "other")
    return B.tail(x.join(y, "replicate").select("replicate", (F.col("rho") - F.col("other")).alias("difference")), "difference")


@query("n08_family_labels")
def n08(spark, d):
    a, _ = _two(spark, d)
    family = np.array([b[-1] for b in BRANDS])
    up = np.triu_indices(len(BRANDS), 1)

    def draw(r):
        f = family if r == 0 else np.random.default_rng([23, r]).permutation(family)
        same = (f[:, None] == f[None, :])[up]
        return {"gap": float(a[up][same].mean() - a[up][~same].mean())}

    return B.tail(B.replicates(spark, 101, draw, ["gap"]), "gap")


@query("n10_mean_over_panels")
def n10(spark, d):
    c = priced(spark, d).withColumn("panel", (F.col("entity") % 3).cast("int"))
    e = G.correlations(c, BRANDS, ["panel"])
    m = [G.matrix(e.where(F.col("panel") == k).na.fill(0.0, ["r"]), len(BRANDS)) for k in range(3)]
    draws = B.relabelled(spark, m[0], m[1], 100, 24).join(B.relabelled(spark, m[0], m[2], 100, 25).withColumnRenamed("rho", "other"), "replicate")
    return B.tail(draws.select("replicate", ((F.col("rho") + F.col("other")) / 2).alias("mean")), "mean")


@query("n14_parallel_analysis")
def n14(spark, d):
    """Observed eigenvalues beside the 95 percent point of the same rank under shuffled columns."""
    w = B.spectra(B.null_moments(dense_rows(spark, d), 64, 40, 26, "columns"), 64)
    long = w.select("replicate", F.posexplode(F.slice("w", 1, 10)).alias("k", "value")).withColumn("rank", F.concat(F.lit("e"), F.col("k").cast("string")))
    q = F.percentile(F.when(F.col("replicate") > 0, F.col("value")), 0.95)
    out = long.groupBy("rank").agg(F.max(F.when(F.col("replicate") == 0, F.col("value"))).alias("observed"), q.alias("envelope"))
    return out.withColumn("kept", (F.col("observed") > F.col("envelope")).cast("int"))


@query("n17_disjoint_halves", f"""WITH {DENSE_SQL}, h AS (SELECT vec_id AS entity, ((row_number() OVER (ORDER BY sha256('27|' || vec_id)) - 1) % 2)::INTEGER AS support FROM embeddings), c AS (SELECT support, d.* FROM dense d JOIN h USING (entity)), e AS ({_ONE.format(g='support', t='c')}) SELECT support, round(4096.0 / (64 + 2 * sum(r * r)), 6) AS pr FROM e GROUP BY 1""")
def n17(spark, d):
    """Participation ratio of two halves of all entities, dealt in hash order."""
    halves = W.numbered(dense_rows(spark, d).withColumn("h", B.hash_order(F.col("entity"), 27)), [], "h").withColumn("support", (F.col("k") % 2).cast("int"))
    e = G.pair_moments(halves, 64, ["support"]).select("support", "i", "j", G.correlation().alias("r"))
    return G.participation(e, 64, ["support"]).select("support", F.round("pr", 6).alias("pr"))


@query("n20_shuffled_factor", f"""WITH {PRICED_SQL}, x AS (SELECT entity, avg(value) AS m, any_value(s_acctbal) AS a FROM priced JOIN supplier ON s_suppkey = entity GROUP BY 1), r AS (SELECT unnest(range(1, 21)) AS replicate),
o AS (SELECT replicate, m, a, row_number() OVER (PARTITION BY replicate ORDER BY sha256('28|' || entity)) AS k, row_number() OVER (PARTITION BY replicate ORDER BY sha256('28|' || replicate || '|' || entity)) AS h FROM x CROSS JOIN r)
SELECT u.replicate, round(corr(u.m, v.a), 8) + 0.0 AS r FROM o u JOIN o v ON u.replicate = v.replicate AND u.k = v.h GROUP BY 1""")
def n20(spark, d):
    """Correlation of each entity's mean with a size column that is dealt anew in hash order, many times."""
    x = priced(spark, d).groupBy("entity").agg(F.avg("value").alias("m")).join(table(spark, d, "supplier").select(F.col("s_suppkey").alias("entity"), F.col("s_acctbal").alias("a")), "entity")
    each = x.withColumn("replicate", F.explode(F.sequence(F.lit(1), F.lit(20)))).withColumn("own", B.hash_order(F.col("entity"), 28))
    each = each.withColumn("new", F.sha2(F.concat_ws("|", F.lit("28"), F.col("replicate").cast("string"), F.col("entity").cast("string")), 256))
    left = W.numbered(each.select("replicate", "m", "own"), ["replicate"], "own").select("replicate", "m", "k")
    right = W.numbered(each.select("replicate", "a", "new"), ["replicate"], "new").select("replicate", "a", "k")
    return left.join(right, ["replicate", "k"]).groupBy("replicate").agg((F.round(F.corr("m", "a"), 8) + 0.0).alias("r"))


@query("b01_row_bootstrap")
def b01(spark, d):
    """Participation ratio of resampled rows; a draw with a constant column is drawn again."""
    return B.interval(B.row_bootstrap(dense_rows(spark, d), 64, 50, 29), "pr")


@query("b04_moment_bootstrap", f"""WITH {DENSE_SQL}, m AS (SELECT a.entity % 20 AS g, a.feature AS i, b.feature AS j, count(*)::DOUBLE AS n, sum(a.value) AS sx, sum(b.value) AS sy, sum(a.value * a.value) AS sxx, sum(b.value * b.value) AS syy, sum(a.value * b.value) AS sxy FROM dense a JOIN dense b ON a.entity = b.entity AND a.feature < b.feature GROUP BY 1, 2, 3),
w AS (SELECT replicate, g, -ln({uniform_sql("'30'", 'replicate', 'g')}) AS w FROM (SELECT unnest(range(10)) AS replicate) CROSS JOIN (SELECT unnest(range(20)) AS g)),
s AS (SELECT replicate, i, j, sum(w * n) AS n, sum(w * sx) AS sx, sum(w * sy) AS sy, sum(w * sxx) AS sxx, sum(w * syy) AS syy, sum(w * sxy) AS sxy FROM m JOIN w USING (g) GROUP BY 1, 2, 3),
r AS (SELECT replicate, (sxy - sx * sy / n) / sqrt((sxx - sx * sx / n) * (syy - sy * sy / n)) AS r FROM s) SELECT replicate::INTEGER AS replicate, round(4096.0 / (64 + 2 * sum(r * r)), 6) AS pr FROM r GROUP BY 1""")
def b04(spark, d):
    """Participation ratio under exponential weights of groups, from their moment tables: entities are read once."""
    c = dense(spark, d).withColumn("g", (F.col("entity") % 20).cast("int"))
    m = G.pair_moments(G.rows_of(c, DENSE, ["g"]), 64, ["g"])
    each = m.withColumn("replicate", F.explode(F.sequence(F.lit(0), F.lit(9))))
    w = -F.log(B.uniform(30, F.col("replicate"), F.col("g")))
    summed = S.merged(S.weighted(each.withColumn("w", w), F.col("w")), ["replicate", "i", "j"])
    return G.participation(summed.select("replicate", "i", "j", G.correlation().alias("r")), 64, ["replicate"]).select("replicate", F.round("pr", 6).alias("pr"))


@query("b12_subsample", "SELECT doc_id FROM (SELECT doc_id, sha256('31|' || doc_id) AS h FROM documents) ORDER BY h, doc_id LIMIT 50")
def b12(spark, d):
    return table(spark, d, "documents").select("doc_id").orderBy(B.hash_order(F.col("doc_id"), 31), "doc_id").limit(50)


@query("b14_balanced_halves", "SELECT doc_id, source, ((row_number() OVER (PARTITION BY source ORDER BY sha256('32|' || doc_id), doc_id) - 1) % 2)::INTEGER AS half FROM documents")
def b14(spark, d):
    """Alternating halves in hash order within each source, numbered by buckets so that no task holds a whole source."""
    docs = table(spark, d, "documents").select("doc_id", "source", B.hash_order(F.col("doc_id"), 32).alias("h")).withColumn("b", F.substring("h", 1, 2))
    n = docs.groupBy("source", "b").agg(F.count(F.lit(1)).alias("n"))
    before = n.select("source", "b", (F.sum("n").over(Window.partitionBy("source").orderBy("b")) - F.col("n")).alias("before"))
    k = F.row_number().over(Window.partitionBy("source", "b").orderBy("h", "doc_id")) - 1
    return docs.withColumn("k", k).join(before, ["source", "b"]).select("doc_id", "source", ((F.col("k") + F.col("before")) % 2).cast("int").alias("half"))


@query("b17_round_robin", "SELECT s_suppkey, (row_number() OVER (PARTITION BY s_nationkey ORDER BY sha256('33|' || s_suppkey), s_suppkey))::INTEGER AS round FROM supplier")
def b17(spark, d):
    w = Window.partitionBy("s_nationkey").orderBy(B.hash_order(F.col("s_suppkey"), 33), "s_suppkey")
    return table(spark, d, "supplier").select("s_suppkey", F.row_number().over(w).alias("round"))


@query("d01_least_squares", "SELECT round(regr_slope(l_extendedprice, l_quantity), 4) AS slope, round(regr_intercept(l_extendedprice, l_quantity), 2) AS intercept FROM lineitem")
def d01(spark, d):
    m = D.normal_moments(table(spark, d, "lineitem"), ["l_quantity"], ["l_extendedprice"])[0]
    b = D.solve(m, 1)
    return spark.createDataFrame([(round(float(b[1, 0]), 4), round(float(b[0, 0]), 2))], "slope double, intercept double")


@query("d06_projected_counts")
def d06(spark, d):
    n = table(spark, d, "conversations").groupBy("conv_id", F.pmod(F.xxhash64("role", "turn"), F.lit(2048)).cast("int").alias("bin")).agg(F.count(F.lit(1)).cast("double").alias("c"))
    counts = n.groupBy("conv_id").agg(F.map_from_entries(F.collect_list(F.struct("bin", "c"))).alias("counts"))
    return D.projected(counts, "counts", 8, 34).select("conv_id", "projection")


@query("d08_ridge")
def d08(spark, d):
    x = table(spark, d, "lineitem").withColumn("fold", (F.col("l_orderkey") % 5).cast("int")).select("fold", "l_quantity", "l_tax", "l_discount", "l_extendedprice")
    p = D.held_out(x, ["l_quantity", "l_tax", "l_discount"], ["l_extendedprice"], "fold", ridge=1.0)
    return D.out_of_fold_r2(p, "l_extendedprice", "p_l_extendedprice")


@query("d20_mixture_weight", f"""WITH {PRICED_SQL}, g AS (SELECT t, (1 - t) * score + t * (score - avg(score) OVER (PARTITION BY feature)) AS s, measured FROM priced CROSS JOIN (VALUES (0.0), (0.5), (1.0)) v(t))
SELECT t::DOUBLE AS alpha, round(corr(s, measured), 7) AS r FROM g GROUP BY 1 ORDER BY r DESC, alpha LIMIT 1""")
def d20(spark, d):
    c = priced(spark, d)
    x = c.join(c.groupBy("feature").agg(F.avg("score").alias("m")), "feature").withColumn("alpha", F.explode(F.array(F.lit(0.0), F.lit(0.5), F.lit(1.0))))
    s = (1 - F.col("alpha")) * F.col("score") + F.col("alpha") * (F.col("score") - F.col("m"))
    return x.withColumn("s", s).groupBy("alpha").agg(F.round(F.corr("s", "measured"), 7).alias("r")).orderBy(F.desc("r"), "alpha").limit(1)


@query("d23_model_comparison", "WITH l AS (SELECT lang, toxic AS y, n_chars AS a, -n_chars AS b FROM documents JOIN labels USING (doc_id)), " + f"r AS (SELECT lang, y, {rank_sql('lang', 'a')} AS ra, {rank_sql('lang', 'b')} AS rb FROM l) SELECT lang, round((sum(ra * y) - sum(rb * y)) / (sum(y) * (count(*) - sum(y))), 8) AS difference FROM r GROUP BY 1 HAVING sum(y) > 0 AND sum(y) < count(*)")
def d23(spark, d):
    x = table(spark, d, "documents").select("doc_id", "lang", F.col("n_chars").alias("a"), (-F.col("n_chars")).alias("b")).join(table(spark, d, "labels").select("doc_id", F.col("toxic").alias("y")), "doc_id")
    one, two = (T.roc_auc(x, "y", s, ["lang"]).withColumnRenamed("auc", s) for s in ("a", "b"))
    return _rounded(one.join(two, "lang").where("a IS NOT NULL").select("lang", (F.col("a") - F.col("b")).alias("difference")), 8, "difference")


@query("s03_declared_features", "SELECT 'feature' AS kind, count(DISTINCT p_brand) AS n FROM part")
def s03(spark, d):
    return table(spark, d, "part").agg(F.lit("feature").alias("kind"), F.countDistinct("p_brand").alias("n"))


@query("w18_total_order", f"WITH {SPARSE_SQL} SELECT entity, feature, value, (row_number() OVER (PARTITION BY feature ORDER BY value, entity))::INTEGER AS place FROM sparse")
def w18(spark, d):
    return sparse(spark, d).withColumn("place", F.row_number().over(Window.partitionBy("feature").orderBy("value", "entity")))


@query("d10_partial_ranks")
def d10(spark, d):
    s = priced(spark, d).join(table(spark, d, "supplier").select(F.col("s_suppkey").alias("entity"), F.col("s_acctbal").alias("a")), "entity").select("feature", "measured", "score", "a")
    s = stored(s, "rank-rows")
    s = reduce(lambda rows, c: rows.join(stored(W.value_ranks(s, c, ["feature"]).withColumnRenamed("rank", f"r_{c}"), "ranks"), ["feature", c]), ("measured", "score", "a"), s)
    r = s.groupBy("feature").agg(*[F.corr(f"r_{x}", f"r_{y}").alias(x[0] + y[0]) for x, y in (("measured", "score"), ("measured", "a"), ("score", "a"))])
    return r.select("feature", D.partial(F.col("ms"), F.col("ma"), F.col("sa")).alias("rho"))
