"""Queries: further ranks, joins and geometry, and nulls, resampling, models and checks."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.text import nfkc_name, position_identity
from ..operators import aggregates as A
from ..operators import cells as C
from ..operators import geometry as G
from ..operators import moments as S
from ..operators import neighbours as K
from ..operators import ranking as R
from ..operators import ranks as W
from ..operators import regress as D
from ..operators import resample as B
from ..operators import retrieval as T
from ..operators import surfaces as M
from ..sources import files
from ..sources.tables import stored, table
from .base import BRANDS, DENSE, DENSE_SQL, PRICED_SQL, SPARSE_SQL, dense, dense_rows, priced, query, rank_sql, sparse, uniform_sql
from .matrices import _labelled, _pairs, _rounded
from .preparation import edges

_EDGES = f"{PRICED_SQL}, e AS (SELECT i, j, round(r, 6) AS r FROM ({_pairs('priced')}))"


@query("s15_file_digests")
def s15(spark, d):
    """Length and digest of every file of every table."""
    return files.digests(spark, f"{d}/*.parquet").select("length", "sha256")


@query("s16_simulated", f"SELECT s_suppkey AS entity, f::INTEGER AS feature, round(s_acctbal / 1000 + f / 10 + {uniform_sql("'44'", 's_suppkey', 'f')}, 8) AS value FROM supplier CROSS JOIN range(20) t(f)")
def s16(spark, d):
    """Cells with each supplier's balance and a feature's place as effects, and noise from hashes of the seed."""
    x = table(spark, d, "supplier").select(F.col("s_suppkey").alias("entity"), "s_acctbal", F.explode(F.sequence(F.lit(0), F.lit(19))).alias("feature"))
    noise = B.uniform(44, F.col("entity"), F.col("feature"))
    return x.select("entity", "feature", F.round(F.col("s_acctbal") / 1000 + F.col("feature") / 10 + noise, 8).alias("value"))


@query("k06_pair_ledger", f"WITH {_EDGES} SELECT i, j, r, abs(r) AS strength, (r > 0)::INTEGER AS positive FROM e")
def k06(spark, d):
    return edges(spark, d).select("i", "j", "r", F.abs("r").alias("strength"), (F.col("r") > 0).cast("int").alias("positive"))


@query("p10_normal_names")
def p10(spark, d):
    return table(spark, d, "benchmark").select("item_id", nfkc_name("text").alias("name"))


@query("p13_renamed", "SELECT n_nationkey AS key, n_name AS name FROM nation")
def p13(spark, d):
    return table(spark, d, "nation").toDF("key", "name", "region").drop("region")


@query("p15_cap_flags", "SELECT event_type, count(*) FILTER (WHERE value >= 100) AS capped, count(*) AS n FROM events GROUP BY 1")
def p15(spark, d):
    return table(spark, d, "events").groupBy("event_type").agg(F.count_if(F.col("value") >= 100).alias("capped"), F.count(F.lit(1)).alias("n"))


@query("p17_scalar_masks", f"WITH {SPARSE_SQL} SELECT e.entity, f.feature, CASE WHEN s.value IS NULL THEN NULL WHEN s.value < 10.5 THEN 0.0 ELSE s.value END AS value FROM (SELECT DISTINCT entity FROM sparse) e CROSS JOIN (SELECT DISTINCT feature FROM sparse) f LEFT JOIN sparse s ON s.entity = e.entity AND s.feature = f.feature")
def p17(spark, d):
    v = F.col("value")
    return C.grid(sparse(spark, d)).select("entity", "feature", F.when(v.isNull(), None).when(v < 10.5, 0.0).otherwise(v).alias("value"))


@query("p18_incidence", f"WITH {SPARSE_SQL} SELECT entity, count(value) AS degree FROM sparse GROUP BY 1")
def p18(spark, d):
    return sparse(spark, d).groupBy("entity").agg(F.sum(F.col("value").isNotNull().cast("int")).alias("degree"))


@query("p22_excluded_keys", "SELECT o_orderkey FROM orders o WHERE NOT EXISTS (SELECT 1 FROM (SELECT l_orderkey AS k FROM lineitem WHERE l_returnflag = 'R' UNION SELECT l_orderkey FROM lineitem WHERE l_quantity > 49) x WHERE x.k = o.o_orderkey)")
def p22(spark, d):
    x = table(spark, d, "lineitem").where("l_returnflag = 'R' OR l_quantity > 49").select(F.col("l_orderkey").alias("o_orderkey"))
    return table(spark, d, "orders").select("o_orderkey").join(x, "o_orderkey", "left_anti")


@query("p23_in_every_group", "SELECT l_partkey FROM (SELECT l_partkey, l_returnflag AS g, min((l_tax > 0.04)::INTEGER) AS a, max((l_tax > 0.04)::INTEGER) AS b FROM lineitem GROUP BY 1, 2) GROUP BY 1 HAVING count(*) FILTER (WHERE a = 0 AND b = 1) = 3")
def p23(spark, d):
    hit = (F.col("l_tax") > 0.04).cast("int")
    g = table(spark, d, "lineitem").groupBy("l_partkey", "l_returnflag").agg(F.min(hit).alias("a"), F.max(hit).alias("b"))
    return g.groupBy("l_partkey").agg(F.count_if((F.col("a") == 0) & (F.col("b") == 1)).alias("n")).where("n = 3").select("l_partkey")


@query("p24_lookup", "SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'final' WHEN 'O' THEN 'open' WHEN 'P' THEN 'partial' END AS status FROM orders")
def p24(spark, d):
    names = F.create_map(*[F.lit(x) for x in ("F", "final", "O", "open", "P", "partial")])
    return table(spark, d, "orders").select("o_orderkey", names[F.col("o_orderstatus")].alias("status"))


@query("p28_reflected", "SELECT event_type, round((b - a) / 2, 6) AS half, round(2 * m - b, 6) AS low, round(2 * m - a, 6) AS high FROM (SELECT event_type, avg(value) AS m, quantile_cont(value, 0.025) AS a, quantile_cont(value, 0.975) AS b FROM events GROUP BY 1)")
def p28(spark, d):
    x = table(spark, d, "events")
    q = W.quantiles(x, "value", {"a": 0.025, "b": 0.975}, ["event_type"]).join(x.groupBy("event_type").agg(F.avg("value").alias("m")), "event_type")
    return q.select("event_type", F.round((F.col("b") - F.col("a")) / 2, 6).alias("half"), F.round(2 * F.col("m") - F.col("b"), 6).alias("low"), F.round(2 * F.col("m") - F.col("a"), 6).alias("high"))


@query("p30_nuisance_features", f"SELECT doc_id, round(({uniform_sql("'11'", 'doc_id')} - 0.5) * sqrt(12.0), 9) AS nuisance FROM documents")
def p30(spark, d):
    u = (B.uniform(11, F.col("doc_id")) - 0.5) * math.sqrt(12)
    return table(spark, d, "documents").select("doc_id", F.round(u, 9).alias("nuisance"))


@query("p31_index_digest", "SELECT source, sha256(string_agg(digest, ',' ORDER BY part)) AS digest FROM (SELECT source, doc_id // 4096 AS part, sha256(string_agg(doc_id::VARCHAR, ',' ORDER BY doc_id)) AS digest FROM documents GROUP BY 1, 2) GROUP BY 1")
def p31(spark, d):
    """A digest of a source's ids: of the digests of its ranges of 4096 ids in order, so that no row holds all ids."""
    ids = F.array_join(F.transform(F.array_sort(F.collect_list("doc_id")), lambda x: x.cast("string")), ",")
    part = table(spark, d, "documents").groupBy("source", F.expr("doc_id div 4096").alias("part")).agg(F.sha2(ids, 256).alias("digest"))
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("part", "digest"))), lambda x: x["digest"]), ",")
    return part.groupBy("source").agg(F.sha2(whole, 256).alias("digest"))


@query("p32_not_finite", "SELECT count(*) FILTER (WHERE x IS NULL OR isnan(x) OR isinf(x)) AS bad FROM (SELECT unnest(embedding) AS x FROM embeddings)")
def p32(spark, d):
    x = table(spark, d, "embeddings").select(F.explode("embedding").alias("x"))
    return x.agg(F.count_if(F.col("x").isNull() | F.isnan("x") | (F.abs("x") == float("inf"))).alias("bad"))


@query("p34_oriented", f"WITH {PRICED_SQL} SELECT entity, feature, measured * -1.0 AS measured, score * 1.0 AS score FROM priced")
def p34(spark, d):
    return priced(spark, d).select("entity", "feature", (F.col("measured") * -1.0).alias("measured"), (F.col("score") * 1.0).alias("score"))


@query("j04_keyed_alignment", "SELECT s_suppkey, s_acctbal, n FROM supplier LEFT JOIN (SELECT l_suppkey, count(*) AS n FROM lineitem GROUP BY 1) ON l_suppkey = s_suppkey")
def j04(spark, d):
    n = table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("s_suppkey")).agg(F.count(F.lit(1)).alias("n"))
    return table(spark, d, "supplier").select("s_suppkey", "s_acctbal").join(n, "s_suppkey", "left")


@query("j10_prefiltered", "SELECT d.doc_id, sha256(text) AS identity FROM documents d WHERE substr(text, 1, 6) IN (SELECT substr(text, 1, 6) FROM benchmark)")
def j10(spark, d):
    short = table(spark, d, "benchmark").select(F.substring("text", 1, 6).alias("k")).distinct()
    docs = table(spark, d, "documents").select("doc_id", "text", F.substring("text", 1, 6).alias("k"))
    return docs.join(short, "k", "left_semi").select("doc_id", F.sha2("text", 256).alias("identity"))


@query("j12_label_pairs", "SELECT a.n_name AS one, b.n_name AS other, (a.n_regionkey = b.n_regionkey)::INTEGER AS same FROM nation a JOIN nation b ON a.n_nationkey < b.n_nationkey")
def j12(spark, d):
    n = table(spark, d, "nation")
    p = n.alias("a").join(F.broadcast(n.alias("b")), F.col("a.n_nationkey") < F.col("b.n_nationkey"))  # 25 nations
    return p.select(F.col("a.n_name").alias("one"), F.col("b.n_name").alias("other"), (F.col("a.n_regionkey") == F.col("b.n_regionkey")).cast("int").alias("same"))


@query("j15_neighbours", """WITH v AS (SELECT p_partkey AS k, (p_retailprice - avg(p_retailprice) OVER ()) / stddev_samp(p_retailprice) OVER () AS x, (p_size - avg(p_size) OVER ()) / stddev_samp(p_size) OVER () AS y FROM part),
a AS (SELECT a.k AS anchor, b.k AS neighbour, row_number() OVER (PARTITION BY a.k ORDER BY round((a.x - b.x) ** 2 + (a.y - b.y) ** 2, 9), b.k) AS rank FROM v a JOIN v b ON a.k <> b.k WHERE a.k % 100 = 0) SELECT anchor, neighbour, rank::INTEGER AS rank FROM a WHERE rank <= 3""")
def j15(spark, d):
    p = table(spark, d, "part").select(F.col("p_partkey").alias("k"), F.col("p_retailprice").alias("x"), F.col("p_size").cast("double").alias("y"))
    return K.nearest(p, "k", ["x", "y"], p.where("k % 100 = 0"), 3)


@query("j17_name_overlap", "SELECT count(*) AS n FROM (SELECT DISTINCT regexp_replace(lower(p_type), '[^a-z0-9]+', ' ', 'g') AS k FROM part) a JOIN (SELECT DISTINCT regexp_replace(lower(p_brand || ' x'), '[^a-z0-9]+', ' ', 'g') AS k FROM part UNION SELECT DISTINCT lower(p_type) FROM part) b USING (k)")
def j17(spark, d):
    key = lambda c: F.regexp_replace(F.lower(c), "[^a-z0-9]+", " ")
    p = table(spark, d, "part")
    a = p.select(key(F.col("p_type")).alias("k")).distinct()
    b = p.select(key(F.concat("p_brand", F.lit(" x"))).alias("k")).union(p.select(F.lower("p_type"))).distinct()
    return a.join(b, "k").agg(F.count(F.lit(1)).alias("n"))


@query("a05_stacked", f"WITH {SPARSE_SQL} SELECT entity, feature, value FROM sparse")
def a05(spark, d):
    return C.wide_cells(C.wide(sparse(spark, d), BRANDS), "entity", BRANDS).where("value IS NOT NULL")


@query("a13_percentiles", "SELECT l_returnflag AS flag, round(quantile_cont(l_extendedprice, 0.1), 6) AS q10, round(quantile_cont(l_extendedprice, 0.9), 6) AS q90 FROM lineitem GROUP BY 1")
def a13(spark, d):
    x = table(spark, d, "lineitem").select(F.col("l_returnflag").alias("flag"), "l_extendedprice")
    return _rounded(W.quantiles(x, "l_extendedprice", {"q10": 0.1, "q90": 0.9}, ["flag"]), 6, "q10", "q90")


@query("a17_pearson", "SELECT l_returnflag AS flag, round(corr(l_quantity, l_extendedprice), 8) AS r, round(covar_samp(l_quantity, l_extendedprice), 4) AS cov FROM lineitem GROUP BY 1")
def a17(spark, d):
    return table(spark, d, "lineitem").groupBy(F.col("l_returnflag").alias("flag")).agg(F.round(F.corr("l_quantity", "l_extendedprice"), 8).alias("r"), F.round(F.covar_samp("l_quantity", "l_extendedprice"), 4).alias("cov"))


@query("a30_descriptor_table", f"""WITH {PRICED_SQL}, x AS (SELECT entity, feature, value, s_acctbal AS a FROM priced JOIN supplier ON s_suppkey = entity), r AS (SELECT feature, {rank_sql('feature', 'value')} AS u, {rank_sql('feature', 'a')} AS v FROM x) SELECT feature, count(*) AS n, round(corr(u, v), 6) + 0.0 AS rho FROM r GROUP BY 1""")
def a30(spark, d):
    x = priced(spark, d).join(table(spark, d, "supplier").select(F.col("s_suppkey").alias("entity"), F.col("s_acctbal").alias("a")), "entity")
    return _rounded(G.row_spearman(x, "value", "a", ["feature"]), 6, "rho")


@query("w04_normal_scores")
def w04(spark, d):
    return M.rank_normal(priced(spark, d))


@query("w05_rank_matrix", f"WITH {_EDGES}, k AS (SELECT i, j, {rank_sql('1', 'r')}::DOUBLE AS rank FROM e) SELECT i, j, rank FROM k UNION ALL SELECT j, i, rank FROM k")
def w05(spark, d):
    return G.mirrored(edges(spark, d).select("i", "j", W.average_rank([], "r").alias("rank")), "rank")


@query("w06_rank_z", f"WITH {_EDGES}, k AS (SELECT i, j, {rank_sql('1', 'r')} AS k FROM e) SELECT i, j, round((k - avg(k) OVER ()) / stddev_samp(k) OVER (), 8) + 0.0 AS z FROM k")
def w06(spark, d):
    k = edges(spark, d).select("i", "j", W.average_rank([], "r").alias("k"))
    s = k.agg(F.avg("k").alias("m"), F.stddev_samp("k").alias("s"))
    return k.join(s).select("i", "j", (F.round((F.col("k") - F.col("m")) / F.col("s"), 8) + 0.0).alias("z"))


@query("w10_best_setting", "SELECT setting, n FROM (SELECT l_linenumber AS setting, count(*) AS n FROM lineitem GROUP BY 1) ORDER BY n DESC, setting LIMIT 1")
def w10(spark, d):
    n = table(spark, d, "lineitem").groupBy(F.col("l_linenumber").alias("setting")).agg(F.count(F.lit(1)).alias("n"))
    return n.orderBy(F.desc("n"), "setting").limit(1)


@query("w14_holm", f"WITH {_EDGES}, p AS (SELECT i, j, 1 - abs(r) AS p FROM e), h AS (SELECT i, j, p, least(1.0, p * (count(*) OVER () - row_number() OVER (ORDER BY p, i || j) + 1)) AS raw FROM p) SELECT i, j, round(max(raw) OVER (ORDER BY p, i || j ROWS UNBOUNDED PRECEDING), 9) AS adjusted FROM h")
def w14(spark, d):
    p = edges(spark, d).select("i", "j", (1 - F.abs("r")).alias("p"), F.concat("i", "j").alias("k"))
    return W.holm(p, "p", "k").select("i", "j", F.round("adjusted", 9).alias("adjusted"))


@query("w15_score_steps", "WITH n AS (SELECT n_chars AS score, sum(toxic) AS p, count(*) AS c FROM documents JOIN labels USING (doc_id) GROUP BY 1) SELECT score, (sum(p) OVER w)::BIGINT AS tp, (sum(c) OVER w)::BIGINT AS n FROM n WINDOW w AS (ORDER BY score DESC ROWS UNBOUNDED PRECEDING)")
def w15(spark, d):
    return T.score_steps(_labelled(spark, d), "y", "score").select("score", "tp", F.col("all").alias("n"))


@query("w19_selection_ranks", "SELECT s_nationkey, s_suppkey, (row_number() OVER (PARTITION BY s_nationkey ORDER BY s_acctbal DESC, s_suppkey))::INTEGER AS rank FROM supplier")
def w19(spark, d):
    return table(spark, d, "supplier").select("s_nationkey", "s_suppkey", F.row_number().over(Window.partitionBy("s_nationkey").orderBy(F.desc("s_acctbal"), "s_suppkey")).alias("rank"))


@query("m12_local_panel", f"WITH {PRICED_SQL} SELECT entity, feature, round(value - avg(value) OVER (PARTITION BY entity), 6) + 0.0 AS value FROM priced WHERE feature < 'Brand#2'")
def m12(spark, d):
    return _rounded(M.centred(priced(spark, d).where("feature < 'Brand#2'"), columns=False), 6, "value")


@query("m15_additive_rank")
def m15(spark, d):
    """Modes of an additive surface of all suppliers whose rows are scaled by their balances: centring leaves one."""
    size = 1 + F.abs("s_acctbal")
    x = F.transform(F.sequence(F.lit(0), F.lit(9)), lambda j: (j - 4.5) * size)  # key + place, less the row's mean
    m = G.pair_moments(table(spark, d, "supplier").select(x.alias("x")), 10).collect()
    c = np.zeros((10, 10))
    for r in m:
        c[r.i, r.j] = c[r.j, r.i] = r.cxy
        c[r.i, r.i], c[r.j, r.j] = r.cxx, r.cyy
    w = np.linalg.eigvalsh(c)
    return spark.createDataFrame([(int((w > 1e-9 * w[-1]).sum()),)], "modes int")


@query("g07_leading_axis")
def g07(spark, d):
    v, cosine = G.leading_axis(G.matrix(G.correlations(dense(spark, d), DENSE), 64))
    return spark.createDataFrame([(k, float(x), cosine) for k, x in enumerate(v)], "feature int, loading double, cosine double")


@query("g08_truncated")
def g08(spark, d):
    k = G.kernel(G.matrix(G.correlations(dense(spark, d), DENSE), 64), 10)
    return spark.createDataFrame([(i, j, float(k[i, j])) for i in range(64) for j in range(i + 1, 64)], "i int, j int, r double")


@query("g10_subspaces")
def g10(spark, d):
    c = dense(spark, d)
    a, b = (G.matrix(G.correlations(c.where(F.col("entity") % 2 == k), DENSE), 64) for k in (0, 1))
    return spark.createDataFrame([(k, float(x)) for k, x in enumerate(G.subspace_cosines(a, b, 5))], "axis int, cosine double")


@query("g11_concordance", f"WITH {PRICED_SQL}, e AS (SELECT a.feature AS i, b.feature AS j, corr(a.value, b.value) AS u, corr(a.score, b.score) AS v FROM priced a JOIN priced b ON a.entity = b.entity AND a.feature < b.feature GROUP BY 1, 2), k AS (SELECT {rank_sql('1', 'u')} AS ru, {rank_sql('1', 'v')} AS rv FROM e) SELECT count(*) AS n, round(corr(ru, rv), 6) + 0.0 AS rho FROM k")
def g11(spark, d):
    c = priced(spark, d)
    a = G.correlations(c, BRANDS).select("i", "j", F.col("r").alias("u"))
    b = G.correlations(c.select("entity", "feature", F.col("score").alias("value")), BRANDS).select("i", "j", F.col("r").alias("v"))
    return _rounded(G.spearman(a.join(b, ["i", "j"]), "u", "v"), 6, "rho")


@query("g13_shrunk", f"""WITH {DENSE_SQL}, n AS (SELECT count(DISTINCT entity)::DOUBLE AS n FROM dense), c AS (SELECT a.feature AS i, b.feature AS j, covar_pop(a.value, b.value) AS c FROM dense a JOIN dense b ON a.entity = b.entity GROUP BY 1, 2),
s AS (SELECT sum(c) FILTER (WHERE i = j) AS t, sum(c * c) AS q FROM c) SELECT round(least(1.0, ((1 - 2 / 64.0) * q + t * t) / ((n + 1 - 2 / 64.0) * (q - t * t / 64))), 6) AS shrinkage, round(t / 64, 8) AS target FROM s, n""")
def g13(spark, d):
    c = dense(spark, d)
    m = G.pair_moments(G.rows_of(c, DENSE), 64)
    off = m.agg(F.sum(F.pow(F.col("cxy") / F.col("n"), 2)).alias("o"), F.max("n").alias("n"))
    own = c.groupBy("feature").agg(F.var_pop("value").alias("v")).agg(F.sum("v").alias("t"), F.sum(F.col("v") ** 2).alias("s"))
    return off.join(own).select(*G.shrinkage(F.col("s") + 2 * F.col("o"), F.col("t"), F.col("n"), 64))


@query("g14_recovery_curve")
def g14(spark, d):
    """Rank correlation of the map over all rows with that of small random supports of them."""
    x = dense_rows(spark, d)
    n = x.count()
    sizes = [s for s in (25, 50, 100) if s <= n]
    full = G.pair_moments(x, 64).select("i", "j", G.correlation().alias("u"))
    part = G.pair_moments(B.supports(x, sizes, 30, 7), 64, ["replicate", "size"]).select("replicate", "size", "i", "j", G.correlation().alias("v"))
    rho = G.spearman(part.join(F.broadcast(full), ["i", "j"]), "u", "v", ["replicate", "size"])
    return B.interval(rho.withColumn("size", F.col("size").cast("double")), "rho", ["size"])


@query("g16_split_halves")
def g16(spark, d):
    c = dense(spark, d)
    fold = c.withColumn("half", B.hash_fold(F.col("entity"), 3, 2))
    e = G.correlations(fold, DENSE, ["half"])
    both = e.where("half = 0").select("i", "j", F.col("r").alias("u")).join(e.where("half = 1").select("i", "j", F.col("r").alias("v")), ["i", "j"])
    return G.spearman(both, "u", "v").select("n", "rho", (2 * F.col("rho") / (1 + F.col("rho"))).alias("reliability"))


@query("g18_quintile_geometry", f"""WITH {DENSE_SQL}, s AS (SELECT entity, avg(value) AS s FROM dense GROUP BY 1), q AS (SELECT quantile_cont(s, [0.2, 0.4, 0.6, 0.8]) AS q FROM s), b AS (SELECT entity, (CASE WHEN s <= q[1] THEN 0 WHEN s <= q[2] THEN 1 WHEN s <= q[3] THEN 2 WHEN s <= q[4] THEN 3 ELSE 4 END)::INTEGER AS bin FROM s, q),
c AS (SELECT b.bin, d.* FROM dense d JOIN b USING (entity)), p AS (SELECT a.bin, a.feature AS i, b.feature AS j, corr(a.value, b.value) AS r FROM c a JOIN c b ON a.entity = b.entity AND a.feature < b.feature GROUP BY 1, 2, 3) SELECT bin, round(4096.0 / (64 + 2 * sum(r * r)), 5) AS pr FROM p GROUP BY 1""")
def g18(spark, d):
    c = dense(spark, d)
    b = W.quantile_bins(c.groupBy("entity").agg(F.avg("value").alias("s")), "s", 5).select("entity", "bin")
    return G.participation(G.correlations(c.join(b, "entity"), DENSE, ["bin"]), 64, ["bin"]).select("bin", F.round("pr", 5).alias("pr"))


@query("g27_leaf_order")
def g27(spark, d):
    m = G.matrix(G.correlations(priced(spark, d), BRANDS), len(BRANDS))
    return spark.createDataFrame([(k, BRANDS[i]) for k, i in enumerate(G.leaf_order(m))], "place int, feature string")


@query("g30_factorial", f"""WITH {PRICED_SQL}, t AS (SELECT entity, feature, value - avg(value) OVER (PARTITION BY entity) AS vc, score - avg(score) OVER (PARTITION BY entity) AS sc, value, score FROM priced),
e AS (SELECT a.feature AS i, b.feature AS j, corr(a.value, b.value) AS v, corr(a.score, b.score) AS s, corr(a.vc, b.vc) AS vc, corr(a.sc, b.sc) AS sc FROM t a JOIN t b ON a.entity = b.entity AND a.feature < b.feature GROUP BY 1, 2),
r AS (SELECT {rank_sql('1', 'v')} AS v, {rank_sql('1', 's')} AS s, {rank_sql('1', 'vc')} AS vc, {rank_sql('1', 'sc')} AS sc FROM e) SELECT round(corr(v, s), 6) + 0.0 AS raw_raw, round(corr(vc, s), 6) + 0.0 AS centred_raw, round(corr(v, sc), 6) + 0.0 AS raw_centred, round(corr(vc, sc), 6) + 0.0 AS centred_centred FROM r""")
def g30(spark, d):
    c = priced(spark, d)
    score = c.select("entity", "feature", F.col("score").alias("value"))
    e = None
    for n, x in (("v", c), ("s", score), ("vc", M.centred(c, columns=False)), ("sc", M.centred(score, columns=False))):
        one = G.correlations(x, BRANDS).select("i", "j", F.col("r").alias(n))
        e = one if e is None else e.join(one, ["i", "j"])
    r = e.select(*[W.average_rank([], n).alias(n) for n in ("v", "s", "vc", "sc")])
    c4 = {"raw_raw": ("v", "s"), "centred_raw": ("vc", "s"), "raw_centred": ("v", "sc"), "centred_centred": ("vc", "sc")}
    return r.agg(*[(F.round(F.corr(*p), 6) + 0.0).alias(n) for n, p in c4.items()])


@query("r02_censored_strata", f"""WITH {PRICED_SQL}, p AS (SELECT a.entity, a.measured - b.measured AS dm, a.score - b.score AS ds, (a.measured < 10.4)::INTEGER + (b.measured < 10.4)::INTEGER AS c FROM priced a JOIN priced b ON a.entity = b.entity AND a.feature < b.feature),
u AS (SELECT CASE c WHEN 0 THEN 'both_exact' ELSE 'floor_exact' END AS stratum, entity, CASE WHEN ds = 0 THEN 0.5 WHEN sign(dm) <> sign(ds) THEN 1.0 ELSE 0.0 END AS k FROM p WHERE c < 2 AND dm <> 0), e AS (SELECT stratum, entity, avg(k) AS m, sum(k) AS s, count(*) AS n FROM u GROUP BY 1, 2) SELECT stratum, round(avg(m), 8) AS by_entity, round(sum(s) / sum(n), 8) AS by_pair, sum(n)::BIGINT AS pairs FROM e GROUP BY 1""")
def r02(spark, d):
    c = priced(spark, d).withColumn("low", (F.col("measured") < 10.4).cast("int"))
    p = R.entity_pairs(c, ["measured", "score", "low"]).withColumn("c", F.col("x_low") + F.col("y_low")).where("c < 2")
    p = p.withColumn("stratum", F.when(F.col("c") == 0, "both_exact").otherwise("floor_exact"))
    return _rounded(R.concordance(p, "measured", "score", by=["stratum"]).select("stratum", "by_entity", "by_pair", "pairs"), 8, "by_entity", "by_pair")


@query("r05_prior_strata", f"""WITH {PRICED_SQL}, m AS (SELECT feature, round(avg(measured), 9) AS prior FROM priced GROUP BY 1), p AS (SELECT sign(a.measured - b.measured) AS dm, sign(x.prior - y.prior) AS dp FROM priced a JOIN priced b ON a.entity = b.entity AND a.feature < b.feature JOIN m x ON x.feature = a.feature JOIN m y ON y.feature = b.feature WHERE a.measured <> b.measured)
SELECT CASE WHEN dp = 0 THEN 'tied' WHEN dp = dm THEN 'right' ELSE 'wrong' END AS prior, count(*) AS pairs FROM p GROUP BY 1""")
def r05(spark, d):
    c = priced(spark, d)
    c = c.join(c.groupBy("feature").agg(F.round(F.avg("measured"), 9).alias("prior")), "feature")
    p = R.entity_pairs(c, ["measured", "prior"])
    dm, dp = F.sign(F.col("x_measured") - F.col("y_measured")), F.sign(F.col("x_prior") - F.col("y_prior"))
    return p.where(dm != 0).groupBy(F.when(dp == 0, "tied").when(dp == dm, "right").otherwise("wrong").alias("prior")).agg(F.count(F.lit(1)).alias("pairs"))


@query("r09_benchmark", f"""WITH {PRICED_SQL}, r AS (SELECT 'absolute' AS rule, entity, feature, measured, score AS s FROM priced UNION ALL SELECT 'feature_centred', entity, feature, measured, score - avg(score) OVER (PARTITION BY feature) FROM priced),
p AS (SELECT a.rule, a.entity, a.measured - b.measured AS dm, round(a.s - b.s, 10) AS ds FROM r a JOIN r b ON a.rule = b.rule AND a.entity = b.entity AND a.feature < b.feature), e AS (SELECT rule, entity, avg(CASE WHEN ds = 0 THEN 0.5 WHEN sign(dm) <> sign(ds) THEN 1.0 ELSE 0.0 END) AS m FROM p WHERE dm <> 0 GROUP BY 1, 2) SELECT rule, round(avg(m), 7) AS by_entity, count(*) AS entities FROM e GROUP BY 1""")
def r09(spark, d):
    c = priced(spark, d)
    f = c.groupBy("feature").agg(F.avg("score").alias("m"))
    rules = F.explode(F.array(F.struct(F.lit("absolute").alias("rule"), F.col("score").alias("s")), F.struct(F.lit("feature_centred").alias("rule"), (F.col("score") - F.col("m")).alias("s"))))
    x = c.join(f, "feature").select("entity", "feature", "measured", rules.alias("r")).select(F.struct("entity", "r.rule").alias("entity"), "feature", "measured", F.round("r.s", 10).alias("s"))
    p = R.entity_pairs(x, ["measured", "s"]).withColumn("x_s", F.round(F.col("x_s") - F.col("y_s"), 10)).withColumn("y_s", F.lit(0.0)).withColumn("rule", F.col("entity.rule"))
    return R.concordance(p, "measured", "s", by=["rule"]).select("rule", F.round("by_entity", 7).alias("by_entity"), "entities")


@query("r11_endpoint_mixing", "SELECT kinds, count(*) AS cells FROM (SELECT user_id, CASE WHEN count(DISTINCT event_type) = 1 THEN 'single' WHEN count(DISTINCT event_type) <= 3 THEN 'mixed' ELSE 'pooled' END AS kinds FROM events GROUP BY 1) GROUP BY 1")
def r11(spark, d):
    n = F.size("k")
    s = table(spark, d, "events").groupBy("user_id").agg(F.collect_set("event_type").alias("k"))
    return s.groupBy(F.when(n == 1, "single").when(n <= 3, "mixed").otherwise("pooled").alias("kinds")).agg(F.count(F.lit(1)).alias("cells"))


@query("r16_winners", f"WITH {PRICED_SQL} SELECT entity, feature AS winner FROM (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY measured DESC, feature DESC) AS k FROM priced) WHERE k = 1")
def r16(spark, d):
    return priced(spark, d).groupBy("entity").agg(F.max_by("feature", F.struct("measured", "feature")).alias("winner"))


@query("t11_metric_record", f"""WITH l AS (SELECT n_chars AS score, toxic AS y FROM documents JOIN labels USING (doc_id)), r AS (SELECT y, {rank_sql('1', 'score')} AS r FROM l), n AS (SELECT score, sum(y) AS p, count(*) AS c FROM l GROUP BY 1), s AS (SELECT *, sum(p) OVER w AS tp, sum(c) OVER w AS a FROM n WINDOW w AS (ORDER BY score DESC ROWS UNBOUNDED PRECEDING))
SELECT (SELECT round((sum(r * y) - sum(y) * (sum(y) + 1) / 2) / (sum(y) * (count(*) - sum(y))), 8) FROM r) AS auc, round(sum(p * tp / a) / sum(p), 8) AS ap FROM s""")
def t11(spark, d):
    x = _labelled(spark, d)
    return _rounded(T.roc_auc(x, "y", "score").join(T.average_precision(x, "y", "score")), 8, "auc", "ap")


def _two(spark, d):
    c = priced(spark, d)
    score = c.select("entity", "feature", F.col("score").alias("value"))
    return tuple(G.matrix(G.correlations(x, BRANDS), len(BRANDS)) for x in (c, score))


@query("n01_relabelled")
def n01(spark, d):
    return B.tail(B.relabelled(spark, *_two(spark, d), 200, 11), "rho")


@query("n04_partial_relabelled")
def n04(spark, d):
    a, b = _two(spark, d)
    return B.tail(B.relabelled(spark, a, b, 100, 12, control=np.abs(a)), "rho")


@query("n05_within_blocks")
def n05(spark, d):
    return B.tail(B.relabelled(spark, *_two(spark, d), 100, 13, blocks=[int(b[-1]) for b in BRANDS]), "rho")


@query("n06_all_orders")
def n06(spark, d):
    """All 82,944 relabellings of 25 brands within ten blocks and a single: the exact share that correlate as much as the true one."""
    blocks = [k // 3 if k < 12 else 4 + (k - 12) // 2 for k in range(len(BRANDS))]
    return B.exact_tail(B.enumerated(spark, *_two(spark, d), blocks))


for _kind in ("columns", "gaussian", "rows"):

    @query(f"n11_null_{_kind}")
    def n11(spark, d, kind=_kind):
        w = B.spectra(B.null_moments(dense_rows(spark, d), 64, 30, 17, kind), 64)
        total = lambda f: F.aggregate("w", F.lit(0.0), lambda t, v: t + f(v))
        draws = w.select("replicate", (total(lambda v: v) ** 2 / total(lambda v: v * v)).alias("pr"), F.get("w", F.lit(0)).alias("top"))
        return B.tail(draws, "pr").join(B.interval(draws.where("replicate > 0"), "top"))


@query("n15_swapped_margins")
def n15(spark, d):
    x = G.rows_of(sparse(spark, d), BRANDS)
    seen = G.pair_moments(x, len(BRANDS)).agg(F.stddev_pop("n")).first()[0]
    m = G.pair_moments(B.traded(x, len(BRANDS), 20, 1000), len(BRANDS), ["replicate"])
    return B.tail(m.groupBy("replicate").agg(F.stddev_pop(S.product_sum()).alias("spread")), "spread", seen)


@query("n21_tail_p", f"WITH {_EDGES} SELECT (1 + count(*) FILTER (WHERE r >= 0.1)) / (count(*) + 1) AS p_upper, (1 + count(*) FILTER (WHERE r <= 0.1)) / (count(*) + 1) AS p_lower FROM e")
def n21(spark, d):
    e = edges(spark, d).select(F.lit(1).alias("replicate"), "r")
    return B.tail(e, "r", 0.1).select("p_upper", "p_lower")


@query("n23_relabelled_pairs", f"WITH {_EDGES}, f AS (SELECT feature, row_number() OVER (ORDER BY feature) AS k FROM (SELECT DISTINCT feature FROM priced)), m AS (SELECT a.feature AS was, b.feature AS now FROM f a JOIN f b ON b.k = 26 - a.k) SELECT least(x.now, y.now) AS i, greatest(x.now, y.now) AS j, r FROM e JOIN m x ON x.was = i JOIN m y ON y.was = j")
def n23(spark, d):
    turned = dict(zip(BRANDS, reversed(BRANDS)))
    m = F.create_map(*[F.lit(v) for k, n in turned.items() for v in (k, n)])
    return edges(spark, d).select(F.least(m[F.col("i")], m[F.col("j")]).alias("i"), F.greatest(m[F.col("i")], m[F.col("j")]).alias("j"), "r")


@query("n25_block_orders", "SELECT s_nationkey AS block, count(*) AS size FROM supplier GROUP BY 1")
def n25(spark, d):
    return table(spark, d, "supplier").groupBy(F.col("s_nationkey").alias("block")).agg(F.count(F.lit(1)).alias("size"))


@query("b02_cluster_bootstrap", f"""WITH p AS (SELECT user_id, sum(value) AS s, count(value) AS n FROM events GROUP BY 1), w AS (SELECT replicate, s, n, -ln({uniform_sql("'5'", 'replicate', 'user_id')}) AS w FROM p CROSS JOIN (SELECT unnest(range(200)) AS replicate)),
m AS (SELECT replicate, sum(w * s) / sum(w * n) AS mean FROM w GROUP BY 1) SELECT round(avg(mean), 8) AS mean, round(stddev_samp(mean), 8) AS sd, round(quantile_cont(mean, 0.025), 8) AS low, round(quantile_cont(mean, 0.975), 8) AS high FROM m""")
def b02(spark, d):
    """Interval of the mean event value under exponential weights of users."""
    i = B.interval(B.bootstrap_means(table(spark, d, "events"), "user_id", "value", 200, 5), "mean")
    return i.select(*[F.round(c, 8).alias(c) for c in i.columns])


@query("b07_union_interval", "SELECT min(a) AS low, max(b) AS high FROM (SELECT event_type, round(quantile_cont(value, 0.025), 6) AS a, round(quantile_cont(value, 0.975), 6) AS b FROM events GROUP BY 1)")
def b07(spark, d):
    q = _rounded(W.quantiles(table(spark, d, "events"), "value", {"a": 0.025, "b": 0.975}, ["event_type"]), 6, "a", "b")
    return q.agg(F.min("a").alias("low"), F.max("b").alias("high"))


_CI = "(SELECT l_returnflag AS flag, avg(l_discount - 0.05) - 1.96 * stddev_samp(l_discount) / sqrt(count(*)) AS low, avg(l_discount - 0.05) + 1.96 * stddev_samp(l_discount) / sqrt(count(*)) AS high FROM lineitem GROUP BY 1)"


def _ci(spark, d):
    m, s = F.avg(F.col("l_discount") - 0.05), 1.96 * F.stddev_samp("l_discount") / F.sqrt(F.count(F.lit(1)))
    return table(spark, d, "lineitem").groupBy(F.col("l_returnflag").alias("flag")).agg((m - s).alias("low"), (m + s).alias("high"))


@query("b08_equivalence", f"SELECT flag, round(greatest(abs(low), abs(high)), 9) AS margin FROM {_CI}")
def b08(spark, d):
    return _ci(spark, d).select("flag", F.round(B.equivalence(F.col("low"), F.col("high")), 9).alias("margin"))


@query("b09_verdicts", f"SELECT flag, CASE WHEN low > 0 THEN 'better' WHEN high < 0 THEN 'worse' WHEN low > -0.001 AND high < 0.001 THEN 'equivalent' ELSE 'undecided' END AS verdict FROM {_CI}")
def b09(spark, d):
    return _ci(spark, d).select("flag", B.verdict(F.col("low"), F.col("high"), 0.001).alias("verdict"))


@query("b10_without_each", f"WITH {DENSE_SQL}, e AS ({_pairs('dense')}), t AS (SELECT sum(r * r) AS t FROM e), q AS (SELECT k, sum(r * r) AS q FROM (SELECT i AS k, r FROM e UNION ALL SELECT j, r FROM e) GROUP BY 1) SELECT k AS dropped, round(3969.0 / (63 + 2 * (t - q)), 6) AS pr FROM q, t")
def b10(spark, d):
    return B.without_each(G.correlations(dense(spark, d), DENSE), 64).select("dropped", F.round("pr", 6).alias("pr"))


@query("b11_jackknife", f"WITH {DENSE_SQL}, e AS ({_pairs('dense')}), t AS (SELECT sum(r * r) AS t FROM e), q AS (SELECT k, sum(r * r) AS q FROM (SELECT i AS k, r FROM e UNION ALL SELECT j, r FROM e) GROUP BY 1), v AS (SELECT 3969.0 / (63 + 2 * (t - q)) AS pr FROM q, t) SELECT count(*) AS n, round(avg(pr), 6) AS mean, round(sqrt(63.0 / 64 * var_pop(pr) * 64), 6) AS se FROM v")
def b11(spark, d):
    return B.jackknife(B.without_each(G.correlations(dense(spark, d), DENSE), 64), "pr").select("n", F.round("mean", 6).alias("mean"), F.round("se", 6).alias("se"))


@query("b13_group_folds", "SELECT s_suppkey, (('0x' || substr(sha256('5|' || s_nationkey), 1, 16))::UBIGINT % 4)::INTEGER AS fold FROM supplier")
def b13(spark, d):
    return table(spark, d, "supplier").select("s_suppkey", B.hash_fold(F.col("s_nationkey"), 5, 4).alias("fold"))


@query("b15_lightest_blocks")
def b15(spark, d):
    n = table(spark, d, "lineitem").groupBy("l_suppkey").agg(F.count(F.lit(1)).alias("n"))
    return B.lightest_blocks(n, "l_suppkey", "n", 6)


@query("b16_disjoint_supports", "SELECT doc_id, ((row_number() OVER (ORDER BY h, doc_id) - 1) % 4)::INTEGER AS support FROM (SELECT doc_id, sha256('9|' || doc_id) AS h FROM documents ORDER BY h, doc_id LIMIT 80)")
def b16(spark, d):
    return B.disjoint_supports(table(spark, d, "documents"), "doc_id", 9, 20, 4)


@query("b19_censoring_sweep", f"WITH {PRICED_SQL} SELECT f::DOUBLE AS floor, round(avg(greatest(value, f)), 8) AS mean, count(*) FILTER (WHERE value <= f) AS censored FROM priced CROSS JOIN (VALUES (10.2), (10.4), (10.6)) g(f) GROUP BY 1")
def b19(spark, d):
    x = priced(spark, d).select("value", F.explode(F.array(F.lit(10.2), F.lit(10.4), F.lit(10.6))).alias("floor"))
    return x.groupBy("floor").agg(F.round(F.avg(F.greatest("value", "floor")), 8).alias("mean"), F.count_if(F.col("value") <= F.col("floor")).alias("censored"))


@query("b21_degree_weights", """WITH d AS (SELECT conv_id, least(count(*), 6) AS g, (count(*) FILTER (WHERE role = 'user'))::INTEGER % 2 AS arm FROM conversations GROUP BY 1), s AS (SELECT g, count(*) FILTER (WHERE arm = 1)::DOUBLE / sum(count(*) FILTER (WHERE arm = 1)) OVER () AS a, count(*) FILTER (WHERE arm = 0)::DOUBLE / sum(count(*) FILTER (WHERE arm = 0)) OVER () AS b FROM d GROUP BY 1)
SELECT g AS degree, round(a / b, 8) AS weight FROM s WHERE a > 0 AND b > 0""")
def b21(spark, d):
    arm = (F.count_if(F.col("role") == "user") % 2).alias("arm")
    g = table(spark, d, "conversations").groupBy("conv_id").agg(F.least(F.count(F.lit(1)), F.lit(6)).alias("degree"), arm)
    n = g.groupBy("degree").agg(F.count_if(F.col("arm") == 1).alias("a"), F.count_if(F.col("arm") == 0).alias("b"))
    t = n.agg(F.sum("a").alias("ta"), F.sum("b").alias("tb"))
    return n.join(t).where("a > 0 AND b > 0").select("degree", F.round((F.col("a") / F.col("ta")) / (F.col("b") / F.col("tb")), 8).alias("weight"))


@query("b23_paired_folds", f"WITH {PRICED_SQL}, f AS (SELECT entity % 5 AS fold, corr(value, score) AS a, corr(value, value + score) AS b FROM priced GROUP BY 1) SELECT round(avg(b - a), 8) AS difference, count(*) FILTER (WHERE b > a) AS better, count(*) AS folds FROM f")
def b23(spark, d):
    f = priced(spark, d).groupBy((F.col("entity") % 5).alias("fold")).agg(F.corr("value", "score").alias("a"), F.corr("value", F.col("value") + F.col("score")).alias("b"))
    return f.agg(F.round(F.avg(F.col("b") - F.col("a")), 8).alias("difference"), F.count_if(F.col("b") > F.col("a")).alias("better"), F.count(F.lit(1)).alias("folds"))


@query("b24_balance", "SELECT round((avg(n_chars) FILTER (WHERE toxic = 1) - avg(n_chars) FILTER (WHERE toxic = 0)) / stddev_samp(n_chars), 8) AS difference FROM documents JOIN labels USING (doc_id)")
def b24(spark, d):
    return A.balance(_labelled(spark, d), "y", "score").select(F.round("difference", 8).alias("difference"))


@query("d02_held_out_model")
def d02(spark, d):
    c = C.wide(dense(spark, d), list(range(8)), "v").withColumn("fold", B.hash_fold(F.col("entity"), 1, 5))
    x, y = [f"v{k}" for k in range(4)], [f"v{k}" for k in range(4, 8)]
    p = D.held_out(c, x, y, "fold")
    scores = [D.out_of_fold_r2(p, n, f"p_{n}").select(F.lit(n).alias("response"), "r2") for n in y]
    out = scores[0]
    for s in scores[1:]:
        out = out.union(s)
    return out


@query("d04_out_of_fold_r2", f"WITH {PRICED_SQL}, f AS (SELECT feature, entity, value, (sum(value) OVER w - value) / (count(*) OVER w - 1) AS p, avg(value) OVER w AS m FROM priced WINDOW w AS (PARTITION BY feature)) SELECT feature, round(1 - sum((value - p) ** 2) / sum((value - m) ** 2), 8) AS r2 FROM f GROUP BY 1")
def d04(spark, d):
    return D.out_of_fold_r2(R.without_self(priced(spark, d)), "value", "others", ["feature"]).select("feature", F.round("r2", 8).alias("r2"))


_DOCR = f"(SELECT {rank_sql('1', 'n_chars')} AS c, {rank_sql('1', 'quality')} AS q, {rank_sql('1', 'toxic')} AS t FROM documents JOIN labels USING (doc_id))"


@query("d11_partial_spearman", f"WITH r AS (SELECT corr(q, t) AS qt, corr(q, c) AS qc, corr(t, c) AS tc FROM {_DOCR}) SELECT round((qt - qc * tc) / sqrt((1 - qc * qc) * (1 - tc * tc)), 8) AS rho FROM r")
def d11(spark, d):
    x = table(spark, d, "documents").select("doc_id", "n_chars").join(table(spark, d, "labels"), "doc_id")
    rows = x = stored(x, "rank-rows")  # so that each rank reads what is written, not the plan of the ranks before
    for n, c in (("c", "n_chars"), ("q", "quality"), ("t", "toxic")):
        x = x.join(stored(W.value_ranks(rows, c).withColumnRenamed("rank", n), "ranks"), c)
    r = x.agg(F.corr("q", "t").alias("qt"), F.corr("q", "c").alias("qc"), F.corr("t", "c").alias("tc"))
    return r.select(F.round(D.partial(F.col("qt"), F.col("qc"), F.col("tc")), 8).alias("rho"))


@query("d12_joint_edges", "WITH r AS (SELECT corr(l_extendedprice, l_quantity) AS y1, corr(l_extendedprice, l_tax) AS y2, corr(l_quantity, l_tax) AS x FROM lineitem), b AS (SELECT *, (y1 - y2 * x) / (1 - x * x) AS b1, (y2 - y1 * x) / (1 - x * x) AS b2 FROM r) SELECT round(b1, 8) AS beta_1, round(b2, 8) + 0.0 AS beta_2, round(b1 * y1 + b2 * y2, 8) AS joint_r2, round(b1 * y1 + b2 * y2 - y2 * y2, 8) AS unique_1, round(b1 * y1 + b2 * y2 - y1 * y1, 8) + 0.0 AS unique_2 FROM b")
def d12(spark, d):
    r = table(spark, d, "lineitem").agg(F.corr("l_extendedprice", "l_quantity").alias("y1"), F.corr("l_extendedprice", "l_tax").alias("y2"), F.corr("l_quantity", "l_tax").alias("x"))
    return r.select(*[(F.round(c, 8) + 0.0).alias(n) for n, c in D.two_predictors(F.col("y1"), F.col("y2"), F.col("x")).items()])


@query("d14_pivot_features")
def d14(spark, d):
    m = G.matrix(G.correlations(dense(spark, d), DENSE), 64)
    return spark.createDataFrame(list(enumerate(G.pivot_features(m, 8, 8))), "place int, feature int")


@query("d15_farthest_features")
def d15(spark, d):
    m = G.matrix(G.correlations(dense(spark, d), DENSE), 64)
    return spark.createDataFrame(list(enumerate(G.farthest_order(1 - m, 10))), "place int, feature int")


@query("d17_degree_features", f"WITH {SPARSE_SQL}, g AS (SELECT feature, count(value) AS g FROM sparse GROUP BY 1) SELECT a.feature AS i, b.feature AS j, round(sqrt(a.g * b.g), 8) AS product, -abs(a.g - b.g) AS gap FROM g a JOIN g b ON a.feature < b.feature")
def d17(spark, d):
    g = sparse(spark, d).groupBy("feature").agg(F.count("value").alias("g"))
    p = g.alias("a").join(g.alias("b"), F.col("a.feature") < F.col("b.feature"))  # features, a declared few
    return p.select(F.col("a.feature").alias("i"), F.col("b.feature").alias("j"), F.round(F.sqrt(F.col("a.g") * F.col("b.g")), 8).alias("product"), (-F.abs(F.col("a.g") - F.col("b.g"))).alias("gap"))


@query("d18_gated_fusion", f"WITH {_EDGES} SELECT i, j, CASE WHEN right(i, 1) <> right(j, 1) THEN round(({rank_sql('1', 'r')} + {rank_sql('1', 'abs(r)')}) / 2, 6) ELSE {rank_sql('1', 'r')}::DOUBLE END AS fused FROM e")
def d18(spark, d):
    e = edges(spark, d).withColumn("s", F.abs("r")).select("i", "j", W.average_rank([], "r").alias("a"), W.average_rank([], "s").alias("b"))
    return e.select("i", "j", F.when(F.substring("i", -1, 1) != F.substring("j", -1, 1), F.round((F.col("a") + F.col("b")) / 2, 6)).otherwise(F.col("a")).alias("fused"))


@query("d19_selected_threshold", "WITH g AS (SELECT t, avg(CASE WHEN n_chars >= t THEN quality ELSE 1 - quality END) AS m FROM (SELECT n_chars, quality FROM documents JOIN labels USING (doc_id)) CROSS JOIN (VALUES (100), (500), (1000)) v(t) GROUP BY 1) SELECT t::INTEGER AS threshold, round(m, 8) AS metric FROM g ORDER BY round(m, 8) DESC, t LIMIT 1")
def d19(spark, d):
    x = table(spark, d, "documents").select("doc_id", "n_chars").join(table(spark, d, "labels"), "doc_id")
    each = x.select("n_chars", "quality", F.explode(F.array(F.lit(100), F.lit(500), F.lit(1000))).alias("threshold"))
    m = each.groupBy("threshold").agg(F.round(F.avg(F.when(F.col("n_chars") >= F.col("threshold"), F.col("quality")).otherwise(1 - F.col("quality"))), 8).alias("metric"))
    return m.orderBy(F.desc("metric"), "threshold").limit(1)


@query("c07_position_identity", "SELECT p_partkey, round(list_sum([(substr(p_name, k, 1) = substr(p_type, k, 1) AND substr(p_name, k, 1) <> '')::INTEGER FOR k IN range(1, greatest(length(p_name), length(p_type)) + 1)]) / greatest(length(p_name), length(p_type)), 6) AS identity FROM part")
def c07(spark, d):
    return table(spark, d, "part").select("p_partkey", F.round(position_identity(F.col("p_name"), F.col("p_type"), F.greatest(F.length("p_name"), F.length("p_type"))), 6).alias("identity"))


@query("c08_same_labels", "SELECT a.n_name AS one, b.n_name AS other, (a.n_regionkey = b.n_regionkey)::DOUBLE AS same FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey")
def c08(spark, d):
    n = table(spark, d, "nation")
    p = n.alias("a").join(n.alias("b"), "n_regionkey").where("a.n_nationkey < b.n_nationkey")
    return p.select(F.col("a.n_name").alias("one"), F.col("b.n_name").alias("other"), F.lit(1.0).alias("same"))


@query("v02_invariants", "SELECT vec_id AS entity, 0.0::DOUBLE AS closure FROM embeddings")
def v02(spark, d):
    """Two-way centring leaves no entity a mean."""
    return M.centred(dense(spark, d)).groupBy("entity").agg((F.round(F.abs(F.sum("value")), 6) + 0.0).alias("closure"))
