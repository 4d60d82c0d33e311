"""Queries: surfaces, geometry, ranking, retrieval."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import geometry as G
from ..operators import ranking as R
from ..operators import ranks as W
from ..operators import retrieval as T
from ..operators import surfaces as M
from ..sources.tables import stored, table
from .base import BRANDS, DENSE, DENSE_SQL, GROUPS_SQL, PRICED_SQL, SPARSE_SQL, dense, dense_rows, groups, priced, query, rank_sql, sparse
from .preparation import edges


def _rounded(df, digits, *columns):
    return df.select(*[(F.round(c, digits) + 0.0).alias(c) if c in columns else F.col(c) for c in df.columns])


_CENTRED = "value - avg(value) OVER (PARTITION BY entity) - avg(value) OVER (PARTITION BY feature) + avg(value) OVER ()"


@query("m01_two_way", f"WITH {DENSE_SQL} SELECT entity, feature, round({_CENTRED}, 7) + 0.0 AS value FROM dense")
def m01(spark, d):
    return _rounded(M.centred(dense(spark, d)), 7, "value")


@query("m02_row_centred", f"WITH {DENSE_SQL} SELECT entity, feature, round(value - avg(value) OVER (PARTITION BY entity), 7) + 0.0 AS value FROM dense")
def m02(spark, d):
    return _rounded(M.centred(dense(spark, d), columns=False), 7, "value")


@query("m03_column_centred", f"WITH {DENSE_SQL} SELECT entity, feature, round(value - avg(value) OVER (PARTITION BY feature), 7) + 0.0 AS value FROM dense")
def m03(spark, d):
    return _rounded(M.centred(dense(spark, d), rows=False), 7, "value")


@query("m04_z_scores", f"WITH {PRICED_SQL} SELECT entity, feature, round((value - avg(value) OVER w) / stddev_samp(value) OVER w, 7) + 0.0 AS value FROM priced WINDOW w AS (PARTITION BY feature)")
def m04(spark, d):
    return _rounded(M.scaled(priced(spark, d)), 7, "value")


@query("m05_population_z", f"WITH {PRICED_SQL} SELECT entity, feature, round((value - avg(value) OVER w) / stddev_pop(value) OVER w, 7) + 0.0 AS value FROM priced WINDOW w AS (PARTITION BY feature)")
def m05(spark, d):
    return _rounded(M.scaled(priced(spark, d), population=True), 7, "value")


@query("m06_surfaces", f"""WITH {PRICED_SQL}, z AS (SELECT entity, feature, (value - avg(value) OVER w) / stddev_samp(value) OVER w AS value FROM priced WINDOW w AS (PARTITION BY feature))
SELECT 'raw' AS surface, entity, feature, round(value, 7) + 0.0 AS value FROM priced UNION ALL SELECT 'two_way', entity, feature, round({_CENTRED}, 7) + 0.0 FROM priced
UNION ALL SELECT 'scaled_two_way', entity, feature, round({_CENTRED}, 7) + 0.0 FROM z""")
def m06(spark, d):
    return _rounded(M.named(priced(spark, d), ["raw", "two_way", "scaled_two_way"]), 7, "value")


@query("m06b_rank_normal")
def m06b(spark, d):
    return M.surface(priced(spark, d), "rank_normal_two_way")


_FIT = f"""{PRICED_SQL}, res AS (SELECT feature, {_CENTRED} AS r FROM priced), rs AS (SELECT feature, stddev_samp(r) AS residual_sd FROM res GROUP BY 1),
fit0 AS (SELECT feature, avg(value) AS mean, stddev_samp(value) AS sd FROM priced GROUP BY 1), grand AS (SELECT avg(value) AS grand FROM priced),
fit AS (SELECT f.*, residual_sd, grand, sqrt(avg(sd * sd + (mean - grand) ** 2) OVER ()) AS pooled_sd FROM fit0 f JOIN rs USING (feature) CROSS JOIN grand)"""


@query("m07_representations", f"""WITH {_FIT}, x AS (SELECT entity, feature, value, mean, sd, residual_sd, grand, avg(value) OVER e AS row_mean, (value - mean) / sd AS z, avg((value - mean) / sd) OVER e AS row_z FROM priced JOIN fit USING (feature) WINDOW e AS (PARTITION BY entity))
SELECT entity, feature, value AS absolute, round(value - mean, 6) + 0.0 AS feature_centred, round(value - mean - row_mean + grand, 6) + 0.0 AS two_way, round(z, 6) + 0.0 AS z, round(z - row_z, 6) + 0.0 AS z_residual, round((value - mean - row_mean + grand) / residual_sd, 6) + 0.0 AS scaled_residual, round(mean, 6) AS prior FROM x""")
def m07(spark, d):
    c = priced(spark, d)
    x = M.represented(c, M.fit_features(c))
    return _rounded(x, 6, *x.columns[3:])


@query("m08_fold_local", f"""WITH {PRICED_SQL}, c AS (SELECT entity, feature, value, (entity % 5)::INTEGER AS fold FROM priced), f AS (SELECT k.fold, c.feature, avg(value) AS m, stddev_samp(value) AS s FROM c CROSS JOIN (SELECT DISTINCT fold FROM c) k WHERE c.fold <> k.fold GROUP BY 1, 2)
SELECT entity, feature, fold, round((value - m) / s, 6) + 0.0 AS value FROM c JOIN f USING (fold, feature)""")
def m08(spark, d):
    c = priced(spark, d).select("entity", "feature", "value", (F.col("entity") % 5).cast("int").alias("fold"))
    return _rounded(M.fold_local(c, "fold", 5), 6, "value")


@query("m09_missing_aware", f"WITH {SPARSE_SQL}, z AS (SELECT entity, feature, CASE WHEN stddev_pop(value) OVER w > 1e-12 THEN (value - avg(value) OVER w) / stddev_pop(value) OVER w END AS value FROM sparse WINDOW w AS (PARTITION BY feature)) SELECT entity, feature, round(value - avg(value) OVER (PARTITION BY entity), 6) + 0.0 AS value FROM z")
def m09(spark, d):
    return _rounded(M.missing_aware(sparse(spark, d)), 6, "value")


@query("m10_weighted_centring", f"""WITH {PRICED_SQL}, w AS (SELECT entity, feature, value, 1.0 + entity % 3 AS w FROM priced), x AS (SELECT *, sum(value * w) OVER (PARTITION BY feature) / sum(w) OVER (PARTITION BY feature) AS c, sum(value * w) OVER () / sum(w) OVER () AS g, avg(value) OVER (PARTITION BY entity) AS r FROM w)
SELECT entity, feature, round(value - r - c + g, 6) + 0.0 AS value FROM x""")
def m10(spark, d):
    c = priced(spark, d).select("entity", "feature", "value", (1.0 + F.col("entity") % 3).alias("w"))
    return _rounded(M.centred(c, weight="w").drop("w"), 6, "value")


@query("m11_variance_shares", f"""WITH {DENSE_SQL}, x AS (SELECT value AS v, avg(value) OVER (PARTITION BY entity) AS r, avg(value) OVER (PARTITION BY feature) AS c, avg(value) OVER () AS g FROM dense), s AS (SELECT sum((r - g) ** 2) AS e, sum((c - g) ** 2) AS f, sum((v - r - c + g) ** 2) AS i, sum((v - g) ** 2) AS t FROM x)
SELECT round(e, 6) AS ss_entity, round(f, 6) AS ss_feature, round(i, 6) AS ss_interaction, round(t, 6) AS ss_total, round(e / t, 8) AS share_entity, round(f / t, 8) AS share_feature, round(i / t, 8) AS share_interaction FROM s""")
def m11(spark, d):
    x = M.variance_shares(dense(spark, d))
    return x.select(*[F.round(c, 6 if c.startswith("ss") else 8).alias(c) for c in x.columns])


@query("m13_row_factors", f"WITH {DENSE_SQL}, s AS (SELECT entity, sum(abs(value)) AS size FROM dense GROUP BY 1), f AS (SELECT entity, median(value / size) AS factor FROM dense JOIN s USING (entity) WHERE value < 0 GROUP BY 1) SELECT entity, feature, round(factor, 8) AS factor, round(value / factor, 5) + 0.0 AS value FROM dense JOIN f USING (entity)")
def m13(spark, d):
    c = dense(spark, d)
    x = M.row_factor(c, c.groupBy("entity").agg(F.sum(F.abs("value")).alias("size")))
    return x.select("entity", "feature", F.round("factor", 8).alias("factor"), (F.round("value", 5) + 0.0).alias("value"))


@query("m14_reconstructed", f"""WITH {PRICED_SQL}, s AS (SELECT entity, 1.0 + entity % 7 AS size FROM priced GROUP BY 1), q AS (SELECT p.entity, p.feature, p.value, size, value / size AS ratio FROM priced p JOIN s USING (entity)),
g AS (SELECT a.feature, a.entity, any_value(a.value) AS y, median(b.ratio) * any_value(a.size) AS p FROM q a JOIN q b ON a.entity = b.entity AND a.feature <> b.feature GROUP BY 1, 2)
SELECT feature, count(p) AS n, round(corr(y, p), 6) + 0.0 AS pearson, round(avg(abs(y - p)), 6) AS mae, round(sqrt(avg((y - p) ** 2)), 6) AS rmse FROM g GROUP BY 1""")
def m14(spark, d):
    c = priced(spark, d)
    x = M.reconstruction(c, c.groupBy("entity").agg((1.0 + F.col("entity") % 7).alias("size")))
    return _rounded(x, 6, "pearson", "mae", "rmse")


@query("m16_slope_corrected", f"""WITH {PRICED_SQL}, z AS (SELECT s_suppkey AS entity, (s_acctbal - avg(s_acctbal) OVER ()) / stddev_samp(s_acctbal) OVER () AS z FROM supplier), s AS (SELECT feature, regr_slope(value, z) AS slope FROM priced JOIN z USING (entity) GROUP BY 1), r AS (SELECT *, slope - avg(slope) OVER () AS rel FROM s)
SELECT entity, feature, round(slope, 6) + 0.0 AS slope, round(value - rel * z, 6) + 0.0 AS value FROM priced JOIN z USING (entity) JOIN r USING (feature)""")
def m16(spark, d):
    x = table(spark, d, "supplier").select(F.col("s_suppkey").alias("entity"), F.col("s_acctbal").alias("x"))
    return _rounded(M.slope_corrected(priced(spark, d), x), 6, "slope", "value")


@query("m17_mixture", f"""WITH {PRICED_SQL}, x AS (SELECT entity, feature, value / stddev_samp(value) OVER (PARTITION BY feature) AS a, {_CENTRED} AS r FROM priced)
SELECT t::DOUBLE AS alpha, entity, feature, round((1 - t) * a + t * r, 6) + 0.0 AS value FROM x CROSS JOIN (VALUES (0.0), (0.5), (1.0)) g(t)""")
def m17(spark, d):
    return _rounded(M.mixture(priced(spark, d), [0.0, 0.5, 1.0]), 6, "value")


@query("m18_fit_record", f"WITH {_FIT} SELECT feature, round(mean, 6) AS mean, round(sd, 6) AS sd, round(residual_sd, 6) AS residual_sd, round(grand, 6) AS grand, round(pooled_sd, 6) AS pooled_sd FROM fit")
def m18(spark, d):
    return _rounded(M.fit_features(priced(spark, d)), 6, "mean", "sd", "residual_sd", "grand", "pooled_sd").select("feature", "mean", "sd", "residual_sd", "grand", "pooled_sd")


def _pairs(cells: str, value: str = "value") -> str:
    return f"SELECT a.feature AS i, b.feature AS j, corr(a.{value}, b.{value}) AS r FROM {cells} a JOIN {cells} b ON a.entity = b.entity AND a.feature < b.feature GROUP BY 1, 2"


@query("g01_correlations", f"WITH {DENSE_SQL} SELECT i, j, round(r, 6) + 0.0 AS r FROM ({_pairs('dense')})")
def g01(spark, d):
    return _rounded(G.correlations(dense(spark, d), DENSE).select("i", "j", "r"), 6, "r")


_SURF = f"""{DENSE_SQL}, rc AS (SELECT entity, feature, value - avg(value) OVER (PARTITION BY entity) AS value FROM dense), tw AS (SELECT entity, feature, {_CENTRED} AS value FROM dense)"""


@query("g03_participation", f"""WITH {_SURF}, p AS (SELECT 'raw' AS surface, * FROM ({_pairs('dense')}) UNION ALL SELECT 'row_centred', * FROM ({_pairs('rc')}) UNION ALL SELECT 'two_way', * FROM ({_pairs('tw')}))
SELECT surface, round(4096.0 / (64 + 2 * sum(r * r)), 6) AS pr, round(avg(r * r), 8) AS mean_r2, round(avg(r), 8) + 0.0 AS mean_r FROM p GROUP BY 1""")
def g03(spark, d):
    """The flagship: effective dimension of each surface; row- and two-way-centred ones must agree."""
    raw = stored(G.covariance_table(dense_rows(spark, d), 64), "covariances")  # features squared; centring rows is algebra on it, centring columns changes nothing
    centred = stored(G.from_covariances(G.projected(raw)), "correlations")
    named = lambda name, r: r.select(F.lit(name).alias("surface"), "i", "j", "r")
    x = named("raw", G.from_covariances(raw)).union(named("row_centred", centred)).union(named("two_way", centred))
    return G.participation(x, 64, ["surface"]).select("surface", F.round("pr", 6).alias("pr"), F.round("mean_r2", 8).alias("mean_r2"), (F.round("mean_r", 8) + 0.0).alias("mean_r"))


@query("g05_covariance_ratio", f"WITH {DENSE_SQL}, c AS (SELECT a.feature = b.feature AS own, covar_samp(a.value, b.value) AS c FROM dense a JOIN dense b ON a.entity = b.entity GROUP BY a.feature, b.feature) SELECT round((sum(c) FILTER (WHERE own)) ** 2 / sum(c * c), 6) AS pr FROM c")
def g05(spark, d):
    c = dense(spark, d)
    off = G.pair_moments(G.rows_of(c, DENSE), 64).select(G.covariance().alias("c")).agg(F.sum(F.col("c") ** 2).alias("q"))
    own = c.groupBy("feature").agg(F.var_samp("value").alias("v")).agg(F.sum("v").alias("t"), F.sum(F.col("v") ** 2).alias("s"))
    return off.join(own).select(F.round(F.col("t") ** 2 / (F.col("s") + 2 * F.col("q")), 6).alias("pr"))


@query("g09_projected_geometry", f"WITH {DENSE_SQL}, rc AS (SELECT entity, feature, value - avg(value) OVER (PARTITION BY entity) AS value FROM dense) SELECT a.feature AS i, b.feature AS j, round(covar_samp(a.value, b.value), 8) + 0.0 AS c FROM rc a JOIN rc b ON a.entity = b.entity GROUP BY 1, 2")
def g09(spark, d):
    c = dense(spark, d)
    off = G.pair_moments(G.rows_of(c, DENSE), 64).select("i", "j", G.covariance().alias("c"))
    own = c.groupBy("feature").agg(F.var_samp("value").alias("c")).select(F.col("feature").alias("i"), F.col("feature").alias("j"), "c")
    full = G.mirrored(off, "c").union(own)
    return _rounded(G.projected(full), 8, "c")


@query("g12_compared", f"""WITH {_SURF}, a AS ({_pairs('dense')}), b AS ({_pairs('tw')}), j AS (SELECT i, j, a.r AS x, b.r AS y FROM a JOIN b USING (i, j)),
k AS (SELECT *, {rank_sql('1', 'x')} AS rx, {rank_sql('1', 'y')} AS ry, (row_number() OVER (ORDER BY abs(x) DESC, i, j) <= ceil(count(*) OVER () * 0.1))::INTEGER AS tx, (row_number() OVER (ORDER BY abs(y) DESC, i, j) <= ceil(count(*) OVER () * 0.1))::INTEGER AS ty FROM j)
SELECT round(corr(rx, ry), 6) AS rho, round(1 - corr(rx, ry), 6) AS distance, round(avg((sign(x) <> sign(y))::INTEGER), 9) AS flipped, round(sum(tx * ty) / sum(greatest(tx, ty)), 9) AS top_jaccard, round(4096.0 / (64 + 2 * sum(x * x)), 6) AS pr_a, round(4096.0 / (64 + 2 * sum(y * y)), 6) AS pr_b,
round(avg(x), 8) + 0.0 AS mean_a, round(avg(y), 8) + 0.0 AS mean_b, round(avg(abs(x)), 8) AS mean_abs_a, round(avg(abs(y)), 8) AS mean_abs_b FROM k""")
def g12(spark, d):
    raw = stored(G.covariance_table(dense_rows(spark, d), 64), "covariances")
    x = G.compared(G.from_covariances(raw), G.from_covariances(G.projected(raw)), 64)
    digits = {"rho": 6, "distance": 6, "flipped": 9, "top_jaccard": 9, "pr_a": 6, "pr_b": 6}
    return x.select(*[(F.round(n, digits.get(n, 8)) + 0.0).alias(n) for n in x.columns])


@query("g17_extreme_supports", f"""WITH {DENSE_SQL}, s AS (SELECT entity, avg(value) AS s FROM dense GROUP BY 1), q AS (SELECT quantile_cont(s, 0.25) AS a, quantile_cont(s, 0.75) AS b FROM s), c AS (SELECT CASE WHEN s <= a THEN -1 ELSE 1 END AS side, d.* FROM dense d JOIN s USING (entity), q WHERE s <= a OR s >= b),
p AS (SELECT a.side, a.feature AS i, b.feature AS j, corr(a.value, b.value) AS r FROM c a JOIN c b ON a.entity = b.entity AND a.feature < b.feature GROUP BY 1, 2, 3) SELECT side::INTEGER AS side, round(4096.0 / (64 + 2 * sum(r * r)), 6) AS pr FROM p GROUP BY 1""")
def g17(spark, d):
    c = dense(spark, d)
    side = W.extremes(c.groupBy("entity").agg(F.avg("value").alias("s")), "s", 0.25).where("side <> 0").select("entity", "side")
    p = G.correlations(c.join(side, "entity"), DENSE, ["side"])
    return G.participation(p, 64, ["side"]).select("side", F.round("pr", 6).alias("pr"))


@query("g20_family_contrast", f"WITH {PRICED_SQL}, e AS ({_pairs('priced')}) SELECT round(avg(r) FILTER (WHERE same), 6) + 0.0 AS within, round(avg(r) FILTER (WHERE NOT same), 6) + 0.0 AS between, round(avg(r) FILTER (WHERE same) - avg(r) FILTER (WHERE NOT same), 6) + 0.0 AS difference FROM (SELECT r, right(i, 1) = right(j, 1) AS same FROM e)")
def g20(spark, d):
    names = F.array(*[F.lit(b) for b in BRANDS])
    e = G.correlations(priced(spark, d), BRANDS)
    same = F.substring(F.get(names, F.col("i")), -1, 1) == F.substring(F.get(names, F.col("j")), -1, 1)
    x = e.agg(F.avg(F.when(same, F.col("r"))).alias("within"), F.avg(F.when(~same, F.col("r"))).alias("between"))
    return _rounded(x.withColumn("difference", F.col("within") - F.col("between")), 6, "within", "between", "difference")


@query("g21_slope_fingerprint", f"WITH {PRICED_SQL}, z AS (SELECT s_suppkey AS entity, (s_acctbal - avg(s_acctbal) OVER ()) / stddev_samp(s_acctbal) OVER () AS z FROM supplier) SELECT feature, round(covar_samp(z, value), 6) + 0.0 AS slope, round(corr(z, value) ** 2, 8) AS r2 FROM priced JOIN z USING (entity) GROUP BY 1")
def g21(spark, d):
    s = table(spark, d, "supplier")
    z = s.join(s.agg(F.avg("s_acctbal").alias("m"), F.stddev_samp("s_acctbal").alias("sd"))).select(F.col("s_suppkey").alias("entity"), ((F.col("s_acctbal") - F.col("m")) / F.col("sd")).alias("z"))
    x = priced(spark, d).join(z, "entity").groupBy("feature").agg(F.covar_samp("z", "value").alias("slope"), (F.corr("z", "value") ** 2).alias("r2"))
    return x.select("feature", (F.round("slope", 6) + 0.0).alias("slope"), F.round("r2", 8).alias("r2"))


@query("g24_edge_stability", f"""WITH {DENSE_SQL}, c AS (SELECT (entity % 5)::INTEGER AS s, * FROM dense), p AS (SELECT a.s, a.feature AS i, b.feature AS j, corr(a.value, b.value) AS r FROM c a JOIN c b ON a.entity = b.entity AND a.feature < b.feature GROUP BY 1, 2, 3)
SELECT i, j, round(avg(r), 6) + 0.0 AS mean, round(stddev_pop(r), 6) AS sd, round(abs(avg(sign(r))), 6) AS sign_agreement FROM p GROUP BY 1, 2""")
def g24(spark, d):
    p = G.pair_moments(dense_rows(spark, d).withColumn("s", (F.col("entity") % 5).cast("int")), 64, ["s"]).select("s", "i", "j", G.correlation().alias("r"))
    return p.groupBy("i", "j").agg((F.round(F.avg("r"), 6) + 0.0).alias("mean"), F.round(F.stddev_pop("r"), 6).alias("sd"), F.round(F.abs(F.avg(F.sign("r"))), 6).alias("sign_agreement"))


@query("g31_panel_concordance", f"""WITH {PRICED_SQL}, {GROUPS_SQL}, c AS (SELECT grp % 5 AS panel, p.* FROM priced p JOIN grp USING (entity)), e AS (SELECT a.panel, a.feature AS i, b.feature AS j, corr(a.value, b.value) AS r FROM c a JOIN c b ON a.entity = b.entity AND a.feature < b.feature GROUP BY 1, 2, 3),
k AS (SELECT x.panel AS one, y.panel AS other, x.r AS u, y.r AS v FROM e x JOIN e y ON x.i = y.i AND x.j = y.j AND x.panel < y.panel), r AS (SELECT one, other, {rank_sql('one, other', 'u')} AS ru, {rank_sql('one, other', 'v')} AS rv FROM k) SELECT one, other, count(*) AS n, round(corr(ru, rv), 6) + 0.0 AS rho FROM r GROUP BY 1, 2""")
def g31(spark, d):
    c = priced(spark, d).join(groups(spark, d), "entity").withColumn("panel", F.col("grp") % 5)
    e = G.correlations(c, BRANDS, ["panel"]).withColumn("r", F.round("r", 12))
    both = e.alias("x").join(e.alias("y"), ["i", "j"]).where("x.panel < y.panel").select(F.col("x.panel").alias("one"), F.col("y.panel").alias("other"), F.col("x.r").alias("u"), F.col("y.r").alias("v"))
    return _rounded(G.spearman(both, "u", "v", ["one", "other"]), 6, "rho")


@query("g32_degeneracy", f"WITH {DENSE_SQL}, e AS ({_pairs('dense')}) SELECT count(DISTINCT round(r, 10)) AS distinct_values, round(min(r), 8) AS least, round(max(r), 8) AS greatest, round(max(abs(r - 1)), 8) AS from_one FROM e")
def g32(spark, d):
    e = G.correlations(dense(spark, d), DENSE)
    return e.agg(F.countDistinct(F.round("r", 10)).alias("distinct_values"), F.round(F.min("r"), 8).alias("least"), F.round(F.max("r"), 8).alias("greatest"), F.round(F.max(F.abs(F.col("r") - 1)), 8).alias("from_one"))


@query("g06_spectrum")
def g06(spark, d):
    s = G.spectrum(G.matrix(G.correlations(dense(spark, d), DENSE), 64))
    return spark.createDataFrame([(k, v) for k, v in s.items()], "measure string, value double")


_PP = "p AS (SELECT a.entity, a.measured - b.measured AS dm, a.score - b.score AS ds FROM priced a JOIN priced b ON a.entity = b.entity AND a.feature < b.feature)"
_CREDIT = "CASE WHEN ds = 0 THEN 0.5 WHEN sign(dm) <> sign(ds) THEN 1.0 ELSE 0.0 END"


def _concordance_sql(tolerance: float) -> str:
    return f"""WITH {PRICED_SQL}, {_PP}, e AS (SELECT entity, avg(c) AS m, sum(c) AS s, count(c) AS n, count(*) FILTER (WHERE NOT used) AS x, count(*) FILTER (WHERE used AND ds = 0) AS t FROM (SELECT *, abs(dm) > {tolerance} AS used, CASE WHEN abs(dm) > {tolerance} THEN {_CREDIT} END AS c FROM p) GROUP BY 1)
SELECT round(avg(m), 8) AS by_entity, round(sum(s) / sum(n), 8) AS by_pair, count(m) AS entities, sum(n)::BIGINT AS pairs, sum(x)::BIGINT AS excluded, sum(t)::BIGINT AS score_ties FROM e"""


@query("r01_concordance", _concordance_sql(0.0))
def r01(spark, d):
    return _rounded(R.concordance(R.entity_pairs(priced(spark, d), ["measured", "score"]), "measured", "score"), 8, "by_entity", "by_pair")


@query("r03_margin_concordance", _concordance_sql(0.1))
def r03(spark, d):
    return _rounded(R.concordance(R.entity_pairs(priced(spark, d), ["measured", "score"]), "measured", "score", 0.1), 8, "by_entity", "by_pair")


@query("r04_pair_accuracy", f"WITH {PRICED_SQL}, p AS (SELECT a.feature AS i, b.feature AS j, a.measured - b.measured AS dm, a.score - b.score AS ds FROM priced a JOIN priced b ON a.entity = b.entity AND a.feature < b.feature) SELECT i, j, count(*) AS n, round(avg({_CREDIT}), 8) AS accuracy FROM p WHERE dm <> 0 GROUP BY 1, 2")
def r04(spark, d):
    p = R.entity_pairs(priced(spark, d), ["measured", "score"])
    dm, ds = F.col("x_measured") - F.col("y_measured"), F.col("x_score") - F.col("y_score")
    return p.where(dm != 0).groupBy(F.col("x_feature").alias("i"), F.col("y_feature").alias("j")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(R.credit(dm, ds)), 8).alias("accuracy"))


@query("r06_entity_spearman", f"""WITH {PRICED_SQL}, r AS (SELECT entity, measured, score, {rank_sql('entity', 'measured')} AS rm, {rank_sql('entity', 'score')} AS rs FROM priced), t AS (SELECT entity, measured, row_number() OVER (PARTITION BY entity ORDER BY score, measured DESC) AS k, max(measured) OVER (PARTITION BY entity) AS best FROM priced)
SELECT entity, n, rho, top1 FROM (SELECT entity, count(*) AS n, round(corr(rm, rs), 8) + 0.0 AS rho FROM r GROUP BY 1) JOIN (SELECT entity, (measured = best)::INTEGER AS top1 FROM t WHERE k = 1) USING (entity) WHERE n >= 3""")
def r06(spark, d):
    return _rounded(R.entity_spearman(priced(spark, d), "measured", "score"), 8, "rho")


_HITS = f"{PRICED_SQL}, h AS (SELECT entity, feature, score, (measured >= 10.597)::INTEGER AS y, {rank_sql('entity', 'score')} AS r, count(*) OVER (PARTITION BY entity) AS n FROM priced)"


@query("r07_entity_auc", f"WITH {_HITS} SELECT entity, round(1 - (sum(r * y) - sum(y) * (sum(y) + 1) / 2) / (sum(y) * (count(*) - sum(y))), 8) AS auc FROM h GROUP BY 1 HAVING sum(y) > 0 AND sum(y) < count(*)")
def r07(spark, d):
    c = priced(spark, d).withColumn("y", (F.col("measured") >= 10.597).cast("int"))
    return _rounded(R.entity_auc(c, "y", "score"), 8, "auc")


@query("r08_retrieval_ranks", f"""WITH {_HITS}, a AS (SELECT entity, (r - 1) / (n - 1) AS place, (r <= 1)::INTEGER AS top1, (r <= 3)::INTEGER AS top3, (r <= 5)::INTEGER AS top5 FROM h WHERE y = 1 AND n > 1), e AS (SELECT entity, avg(place) AS p, avg(top1) AS t1, avg(top3) AS t3, avg(top5) AS t5 FROM a GROUP BY 1)
SELECT (SELECT round(avg(p), 8) FROM e) AS place_by_entity, (SELECT round(avg(t1), 8) FROM e) AS top1_by_entity, (SELECT round(avg(t3), 8) FROM e) AS top3_by_entity, (SELECT round(avg(t5), 8) FROM e) AS top5_by_entity, round(avg(place), 8) AS place_by_pair, round(avg(top1), 8) AS top1_by_pair, round(avg(top3), 8) AS top3_by_pair, round(avg(top5), 8) AS top5_by_pair FROM a""")
def r08(spark, d):
    c = priced(spark, d).withColumn("y", (F.col("measured") >= 10.597).cast("int"))
    x = R.retrieval_ranks(c, "y", "score")
    return _rounded(x, 8, *x.columns)


@query("r10_leave_group_out", f"WITH {PRICED_SQL}, {GROUPS_SQL}, c AS (SELECT p.entity, feature, grp, value FROM priced p JOIN grp USING (entity)), g AS (SELECT feature, grp, sum(value) AS s, count(*) AS n FROM c GROUP BY 1, 2), t AS (SELECT feature, sum(s) AS s, sum(n) AS n FROM g GROUP BY 1) SELECT c.entity, c.feature, c.grp, c.value, round(CASE WHEN t.n > g.n THEN (t.s - g.s) / (t.n - g.n) ELSE t.s / t.n END, 6) AS prior FROM c JOIN g USING (feature, grp) JOIN t USING (feature)")
def r10(spark, d):
    return _rounded(R.without_own_group(priced(spark, d).join(groups(spark, d), "entity").select("entity", "feature", "grp", "value"), "grp"), 6, "prior")


@query("r17_leave_one_out", f"WITH {PRICED_SQL} SELECT entity, feature, value, round((sum(value) OVER w - value) / (count(*) OVER w - 1), 6) AS others FROM priced WINDOW w AS (PARTITION BY feature)")
def r17(spark, d):
    return _rounded(R.without_self(priced(spark, d)), 6, "others")


@query("r15_feature_support", f"WITH {SPARSE_SQL} SELECT feature, count(value) AS n, min(value) AS least, max(value) AS greatest, round(avg((value >= 11.156)::INTEGER), 8) AS at_ceiling FROM sparse GROUP BY 1")
def r15(spark, d):
    return sparse(spark, d).groupBy("feature").agg(F.count("value").alias("n"), F.min("value").alias("least"), F.max("value").alias("greatest"), F.round(F.avg((F.col("value") >= 11.156).cast("int")), 8).alias("at_ceiling"))


_LAB = "l AS (SELECT doc_id, lang, n_chars AS score, toxic AS y FROM documents JOIN labels USING (doc_id))"


def _labelled(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "lang", F.col("n_chars").alias("score"))
    return docs.join(table(spark, d, "labels").select("doc_id", F.col("toxic").alias("y")), "doc_id")


@query("t01_roc_auc", f"WITH {_LAB} SELECT lang, round(CASE WHEN sum(y) > 0 AND sum(y) < count(*) THEN (sum(r * y) - sum(y) * (sum(y) + 1) / 2) / (sum(y) * (count(*) - sum(y))) END, 8) AS auc FROM (SELECT *, {rank_sql('lang', 'score')} AS r FROM l) GROUP BY 1")
def t01(spark, d):
    return _rounded(T.roc_auc(_labelled(spark, d), "y", "score", ["lang"]), 8, "auc")


@query("t02_sequential_precision", f"WITH {_LAB}, s AS (SELECT lang, y, row_number() OVER w AS k, sum(y) OVER (PARTITION BY lang ORDER BY score DESC, doc_id DESC ROWS UNBOUNDED PRECEDING) AS tp FROM l WINDOW w AS (PARTITION BY lang ORDER BY score DESC, doc_id DESC)) SELECT lang, round(sum(y * tp / k) / sum(y), 8) AS ap FROM s GROUP BY 1")
def t02(spark, d):
    return _rounded(T.sequential_precision(_labelled(spark, d), "y", "score", "doc_id", ["lang"]), 8, "ap")


@query("t03_average_precision", f"WITH {_LAB}, n AS (SELECT lang, score, sum(y) AS p, count(*) AS c FROM l GROUP BY 1, 2), s AS (SELECT *, sum(p) OVER w AS tp, sum(c) OVER w AS a FROM n WINDOW w AS (PARTITION BY lang ORDER BY score DESC ROWS UNBOUNDED PRECEDING)) SELECT lang, round(sum(p * tp / a) / sum(p), 8) AS ap FROM s GROUP BY 1")
def t03(spark, d):
    return _rounded(T.average_precision(_labelled(spark, d), "y", "score", ["lang"]), 8, "ap")


@query("t04_precision_at_positives", f"WITH {_LAB}, s AS (SELECT lang, y, row_number() OVER (PARTITION BY lang ORDER BY score DESC, doc_id DESC) AS k, sum(y) OVER (PARTITION BY lang) AS n FROM l) SELECT lang, round(sum(y) / any_value(n), 8) AS precision FROM s WHERE k <= n GROUP BY 1")
def t04(spark, d):
    return _rounded(T.precision_at_positives(_labelled(spark, d), "y", "score", "doc_id", ["lang"]), 8, "precision")


@query("t05_tied_ranks", """WITH x AS (SELECT user_id AS q, event_type, count(*) AS s FROM events GROUP BY 1, 2), o AS (SELECT q, max(s) AS own FROM x WHERE event_type = 'purchase' GROUP BY 1), n AS (SELECT q, count(*) FILTER (WHERE s > own) AS above, count(*) FILTER (WHERE s = own) AS tied FROM x JOIN o USING (q) GROUP BY 1)
SELECT q, above, tied, round(greatest(0.0, least(1.0, (2 - above) / tied)), 8) AS top_chance, round(list_sum([1 / r FOR r IN range(above + 1, above + tied + 1)]) / tied, 8) AS reciprocal FROM n""")
def t05(spark, d):
    x = table(spark, d, "events").groupBy(F.col("user_id").alias("q"), "event_type").agg(F.count(F.lit(1)).alias("s")).withColumn("y", (F.col("event_type") == "purchase").cast("int"))
    return _rounded(T.tied_ranks(x, "q", "s", "y", 2), 8, "top_chance", "reciprocal")


@query("t06_best_partners", f"""WITH {PRICED_SQL}, e AS (SELECT a.feature AS i, b.feature AS j, round(corr(a.value, b.value), 6) AS r, round(corr(a.score, b.score), 6) AS s FROM priced a JOIN priced b ON a.entity = b.entity AND a.feature < b.feature GROUP BY 1, 2),
m AS (SELECT i AS q, j AS partner, r, s FROM e UNION ALL SELECT j, i, r, s FROM e), k AS (SELECT q, partner, row_number() OVER (PARTITION BY q ORDER BY r DESC, partner) AS t, row_number() OVER (PARTITION BY q ORDER BY s DESC, partner) AS rank FROM m)
SELECT q, partner, rank::INTEGER AS rank, (rank = 1)::INTEGER AS top1, (rank <= 3)::INTEGER AS top3, round(1 / rank, 8) AS reciprocal FROM k WHERE t = 1""")
def t06(spark, d):
    c = priced(spark, d)
    names = F.array(*[F.lit(b) for b in BRANDS])
    s = G.correlations(c.select("entity", "feature", F.col("score").alias("value")), BRANDS).select(F.get(names, F.col("i")).alias("i"), F.get(names, F.col("j")).alias("j"), F.round("r", 6).alias("s"))
    return _rounded(T.best_partners(edges(spark, d).join(s, ["i", "j"]), "r", "s"), 8, "reciprocal")


@query("t10_threshold_grid", f"WITH {_LAB}, g AS (SELECT f, n_chars_cut, y, score FROM l CROSS JOIN (VALUES (0.1), (0.5)) a(f) CROSS JOIN (VALUES (500), (2000)) b(n_chars_cut)) SELECT f::DOUBLE AS share, n_chars_cut::INTEGER AS least, count(*) AS n, round(avg(y), 8) AS positives, avg(y) >= f AS reached FROM g WHERE score >= n_chars_cut GROUP BY 1, 2, f")
def t10(spark, d):
    """Positives among all labelled rows of at least a score, and whether they reach a share."""
    steps = F.explode(F.array(*[F.struct(F.lit(f).alias("share"), F.lit(c).alias("least")) for f in (0.1, 0.5) for c in (500, 2000)]))
    x = _labelled(spark, d).select("y", "score", steps.alias("g")).where(F.col("score") >= F.col("g.least"))
    n = x.groupBy("g.share", "g.least").agg(F.count(F.lit(1)).alias("n"), F.avg("y").alias("p"))
    return n.select("share", "least", "n", F.round("p", 8).alias("positives"), (F.col("p") >= F.col("share")).alias("reached"))


@query("t10_upper_fractions", f"""WITH {_LAB}, c AS (SELECT score, count(*) AS c FROM l WHERE score IS NOT NULL GROUP BY 1), a AS (SELECT score, sum(c) OVER (ORDER BY score DESC) AS reached, sum(c) OVER () AS n FROM c),
k AS (SELECT t, max(score) FILTER (WHERE reached * 10 >= n * t) AS cut FROM a CROSS JOIN (VALUES (1), (5)) f(t) GROUP BY 1)
SELECT t / 10 AS share, least, count(*) AS n, count(*) FILTER (WHERE score >= cut) AS marked, round(avg(y) FILTER (WHERE score >= cut), 8) AS positives FROM l CROSS JOIN k CROSS JOIN (VALUES (500), (2000)) b(least) WHERE score >= least GROUP BY 1, 2""")
def t10_upper(spark, d):
    """All labelled rows of at least a score, those of them in the upper fraction of all labelled scores, and the positives among these."""
    x = _labelled(spark, d)
    g = x.withColumn("least", F.explode(F.array(F.lit(500), F.lit(2000)))).where("score >= least").join(F.broadcast(W.upper_cuts(x, "score", [1, 5])))
    inside = F.col("score") >= F.col("cut")
    return g.groupBy((F.col("tenths") / 10).alias("share"), "least").agg(F.count(F.lit(1)).alias("n"), F.count_if(inside).alias("marked"), F.round(F.avg(F.when(inside, F.col("y"))), 8).alias("positives"))
