"""Queries: scans, projections, joins, aggregations, ranks and sets."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import aggregates as A
from ..operators import cells as C
from ..operators import contracts
from ..operators import geometry as G
from ..operators import moments as S
from ..operators import ranks as W
from ..operators.rectangles import largest_complete
from ..operators.resample import hash_fold
from ..sources import sinks
from ..sources.tables import table
from .base import BRANDS, DENSE_SQL, GROUPS_SQL, PRICED_SQL, SPARSE_SQL, dense, groups, priced, query, rank_sql, sparse


@query("s02_pruned_scan", "SELECT l_suppkey, count(*) AS n FROM lineitem WHERE l_quantity > 45 GROUP BY 1")
def s02(spark, d):
    return table(spark, d, "lineitem").select("l_suppkey", "l_quantity").where("l_quantity > 45").groupBy("l_suppkey").agg(F.count(F.lit(1)).alias("n"))


@query("s11_wide_union", "SELECT vec_id AS entity, round(list_sum(embedding::DOUBLE[]), 6) + 0.0 AS total FROM embeddings")
def s11(spark, d):
    return dense(spark, d).groupBy("entity").agg((F.round(F.sum("value"), 6) + 0.0).alias("total"))


@query("k03_json_rows", "SELECT o_orderkey, '{\"o_orderkey\":' || o_orderkey || ',\"o_orderstatus\":\"' || o_orderstatus || '\"}' AS value FROM orders")
def k03(spark, d):
    o = table(spark, d, "orders").select("o_orderstatus", "o_orderkey")
    return o.select("o_orderkey", F.to_json(F.struct("o_orderkey", "o_orderstatus")).alias("value"))


@query("k04_flat_report", "SELECT p_brand AS \"key.brand\", count(*) AS \"stat.n\", round(avg(p_retailprice), 6) AS \"stat.mean\" FROM part GROUP BY 1")
def k04(spark, d):
    g = table(spark, d, "part").groupBy("p_brand").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("p_retailprice"), 6).alias("mean"))
    return sinks.flat(g.select(F.struct(F.col("p_brand").alias("brand")).alias("key"), F.struct("n", "mean").alias("stat")))


@query("p01_coerced", "SELECT count(*) AS n, count(try_cast(nullif(regexp_extract(props, '[0-9.]+'), '') AS DOUBLE)) AS numbers FROM events")
def p01(spark, d):
    x = C.number(F.regexp_extract("props", "[0-9.]+", 0))
    return table(spark, d, "events").agg(F.count(F.lit(1)).alias("n"), F.count(x).alias("numbers"))


@query("p02_clipped", f"WITH {DENSE_SQL} SELECT feature, round(avg(CASE WHEN value > 0 THEN 0.0 ELSE value END), 6) AS mean FROM dense GROUP BY 1")
def p02(spark, d):
    return dense(spark, d).groupBy("feature").agg(F.round(F.avg(C.clip_above(F.col("value"))), 6).alias("mean"))


@query("p03_complete_cases", f"WITH {SPARSE_SQL} SELECT entity, feature, value FROM sparse WHERE entity IN (SELECT entity FROM sparse GROUP BY 1 HAVING count(value) = 25)")
def p03(spark, d):
    return C.complete_cases(sparse(spark, d), 25)


_GRID = f"{SPARSE_SQL}, full_grid AS (SELECT e.entity, f.feature, s.value FROM (SELECT DISTINCT entity FROM sparse) e CROSS JOIN (SELECT DISTINCT feature FROM sparse) f LEFT JOIN sparse s ON s.entity = e.entity AND s.feature = f.feature)"


@query("p04_mean_filled", f"WITH {_GRID} SELECT entity, feature, round(coalesce(value, avg(value) OVER (PARTITION BY feature)), 6) AS value FROM full_grid")
def p04(spark, d):
    return C.fill(C.grid(sparse(spark, d)), "mean").withColumn("value", F.round("value", 6))


@query("p05_median_filled", f"WITH {_GRID} SELECT entity, feature, round(coalesce(value, median(value) OVER (PARTITION BY feature)), 6) AS value FROM full_grid")
def p05(spark, d):
    return C.fill(C.grid(sparse(spark, d)), "median").withColumn("value", F.round("value", 6))


@query("p07_without_sparsest", f"WITH {_GRID}, worst AS (SELECT feature FROM full_grid GROUP BY 1 ORDER BY count(*) - count(value) DESC, feature LIMIT 1) SELECT entity, feature, value FROM full_grid WHERE feature NOT IN (SELECT feature FROM worst)")
def p07(spark, d):
    return C.drop_sparsest(C.grid(sparse(spark, d)))


@query("p08_exact_relation", "SELECT o_orderkey FROM orders WHERE o_totalprice IS NOT NULL AND o_orderstatus = 'F' AND o_orderpriority IN ('1-URGENT', '2-HIGH')")
def p08(spark, d):
    return table(spark, d, "orders").where(F.col("o_totalprice").isNotNull() & (F.col("o_orderstatus") == "F") & F.col("o_orderpriority").isin("1-URGENT", "2-HIGH")).select("o_orderkey")


@query("p09_normal_text", "SELECT upper(trim(coalesce(event_type, ''))) AS kind, count(*) AS n FROM events GROUP BY 1")
def p09(spark, d):
    return table(spark, d, "events").groupBy(F.upper(F.trim(F.coalesce("event_type", F.lit("")))).alias("kind")).agg(F.count(F.lit(1)).alias("n"))


@query("p11_valid_keys", "SELECT page_id FROM pages WHERE regexp_matches(url, '^https?://[a-z0-9.-]+/[a-z]{2}/[0-9]+') AND page_id > 0")
def p11(spark, d):
    return table(spark, d, "pages").where(F.col("url").rlike("^https?://[a-z0-9.-]+/[a-z]{2}/[0-9]+") & (F.col("page_id") > 0)).select("page_id")


@query("p12_key_prefix", "SELECT substr(sha256(source || lang), 1, 14) AS block, count(*) AS n FROM documents GROUP BY 1")
def p12(spark, d):
    return table(spark, d, "documents").groupBy(F.substring(F.sha2(F.concat("source", "lang"), 256), 1, 14).alias("block")).agg(F.count(F.lit(1)).alias("n"))


@query("p14_log_units", "SELECT p_partkey, round(9 - log10(p_retailprice), 9) AS level FROM part")
def p14(spark, d):
    return table(spark, d, "part").select("p_partkey", F.round(9 - F.log10("p_retailprice"), 9).alias("level"))


@query("p16_censored_endpoint", """SELECT event_id, CASE WHEN value <= 20 THEN 1 WHEN value >= 40 THEN 0 END AS label FROM events
WHERE (value <= 20 OR value >= 40)""")
def p16(spark, d):
    label = F.when(F.col("value") <= 20, 1).when(F.col("value") >= 40, 0)
    return table(spark, d, "events").select("event_id", label.alias("label")).where("label IS NOT NULL")


@query("p19_active_share", f"WITH {PRICED_SQL} SELECT entity, round(avg((value >= 10.545)::INTEGER), 9) AS degree FROM priced GROUP BY 1")
def p19(spark, d):
    return priced(spark, d).groupBy("entity").agg(F.round(F.avg((F.col("value") >= 10.545).cast("int")), 9).alias("degree"))


@query("p20_distinct_rows", "SELECT DISTINCT lang, source FROM documents")
def p20(spark, d):
    return table(spark, d, "documents").select("lang", "source").distinct()


@query("p21_repeated_keys", "SELECT user_id, event_type, count(*) AS n FROM events GROUP BY 1, 2 HAVING count(*) > 1")
def p21(spark, d):
    return contracts.duplicates(table(spark, d, "events"), ["user_id", "event_type"])


@query("p25_class_labels", """WITH f AS (SELECT l_partkey, bool_or(l_returnflag = 'R') AS a, bool_or(l_returnflag = 'N') AS b FROM lineitem GROUP BY 1)
SELECT l_partkey, CASE WHEN a AND b THEN 'shared' WHEN a THEN 'a_only' WHEN b THEN 'b_only' ELSE 'none' END AS class FROM f""")
def p25(spark, d):
    f = table(spark, d, "lineitem").groupBy("l_partkey").agg(F.bool_or(F.col("l_returnflag") == "R").alias("a"), F.bool_or(F.col("l_returnflag") == "N").alias("b"))
    return f.select("l_partkey", F.when(F.col("a") & F.col("b"), "shared").when(F.col("a"), "a_only").when(F.col("b"), "b_only").otherwise("none").alias("class"))


@query("p26_unordered_pairs", "SELECT least(c_nationkey, s_nationkey) AS a, greatest(c_nationkey, s_nationkey) AS b, count(*) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1, 2")
def p26(spark, d):
    t = lambda n, *c: table(spark, d, n).select(*c)
    x = t("lineitem", "l_orderkey", "l_suppkey").join(t("orders", "o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    x = x.join(t("customer", "c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey")).join(t("supplier", "s_suppkey", "s_nationkey"), F.col("l_suppkey") == F.col("s_suppkey"))
    return x.groupBy(F.least("c_nationkey", "s_nationkey").alias("a"), F.greatest("c_nationkey", "s_nationkey").alias("b")).agg(F.count(F.lit(1)).alias("n"))


@query("p27_efficiency", "SELECT p_partkey, round(p_retailprice / nullif(p_size, 0), 6) AS efficiency FROM part")
def p27(spark, d):
    return table(spark, d, "part").select("p_partkey", F.round(F.col("p_retailprice") / F.nullif("p_size", F.lit(0)), 6).alias("efficiency"))


@query("p29_hash_folds", "SELECT doc_id, (('0x' || substr(sha256('7|' || doc_id), 1, 16))::UBIGINT % 5)::INTEGER AS fold FROM documents")
def p29(spark, d):
    return table(spark, d, "documents").select("doc_id", hash_fold(F.col("doc_id"), 7, 5).alias("fold"))


@query("p33_id_lists", "SELECT page_id, unnest(string_split(split_part(url, '://', 2), '/')) AS part FROM pages")
def p33(spark, d):
    return table(spark, d, "pages").select("page_id", F.explode(F.split(F.split_part("url", F.lit("://"), F.lit(2)), "/")).alias("part"))


@query("j01_validated_join", "SELECT n_name, count(*) AS suppliers, round(avg(s_acctbal), 6) AS mean FROM supplier JOIN nation ON s_nationkey = n_nationkey GROUP BY 1")
def j01(spark, d):
    s = table(spark, d, "supplier").withColumnRenamed("s_nationkey", "n_nationkey")
    j = contracts.validated_join(s, table(spark, d, "nation"), ["n_nationkey"], validate="many_to_one")
    return j.groupBy("n_name").agg(F.count(F.lit(1)).alias("suppliers"), F.round(F.avg("s_acctbal"), 6).alias("mean"))


@query("j02_left_join", "SELECT d.doc_id, l.quality FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id")
def j02(spark, d):
    return contracts.validated_join(table(spark, d, "documents").select("doc_id"), table(spark, d, "labels").select("doc_id", "quality"), ["doc_id"], "left")


@query("j03_successive_joins", """SELECT a.l_suppkey, a.n, b.total, c.parts FROM (SELECT l_suppkey, count(*) AS n FROM lineitem GROUP BY 1) a
JOIN (SELECT l_suppkey, round(sum(l_quantity), 6) AS total FROM lineitem GROUP BY 1) b USING (l_suppkey) JOIN (SELECT l_suppkey, count(DISTINCT l_partkey) AS parts FROM lineitem GROUP BY 1) c USING (l_suppkey)""")
def j03(spark, d):
    g = table(spark, d, "lineitem").groupBy("l_suppkey")
    return C.successive([g.agg(F.count(F.lit(1)).alias("n")), g.agg(F.round(F.sum("l_quantity"), 6).alias("total")), g.agg(F.countDistinct("l_partkey").alias("parts"))], "l_suppkey")


@query("j05_semi_join", "SELECT doc_id, lang FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1)")
def j05(spark, d):
    return table(spark, d, "documents").select("doc_id", "lang").join(table(spark, d, "labels").where("toxic = 1"), "doc_id", "left_semi")


@query("j06_anti_join", "SELECT doc_id, lang FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)")
def j06(spark, d):
    return table(spark, d, "documents").select("doc_id", "lang").join(table(spark, d, "labels"), "doc_id", "left_anti")


_PIVOT = ", ".join(f"max(value) FILTER (WHERE feature = '{b}') AS \"{b}\"" for b in BRANDS)


@query("j07_declared_order", f"WITH {SPARSE_SQL} SELECT entity, {_PIVOT} FROM sparse GROUP BY 1")
def j07(spark, d):
    return C.wide(sparse(spark, d), BRANDS)


@query("j09_identity_levels", """WITH b AS (SELECT item_id, sha256(text) AS whole, sha256(lower(text)) AS folded, sha256(substr(text, 1, 14)) AS start FROM benchmark),
d AS (SELECT doc_id, sha256(text) AS whole, sha256(lower(text)) AS folded, sha256(substr(text, 1, 14)) AS start FROM documents)
SELECT 'whole' AS level, count(*) AS n FROM d JOIN b USING (whole) UNION ALL SELECT 'folded', count(*) FROM d JOIN b USING (folded) UNION ALL SELECT 'start', count(*) FROM d JOIN b USING (start)""")
def j09(spark, d):
    keys = {"whole": F.sha2("text", 256), "folded": F.sha2(F.lower("text"), 256), "start": F.sha2(F.substring("text", 1, 14), 256)}
    a, b = (table(spark, d, t).select(*[k.alias(n) for n, k in keys.items()]) for t in ("documents", "benchmark"))
    return reduce(lambda x, y: x.union(y), [a.join(b, n).agg(F.lit(n).alias("level"), F.count(F.lit(1)).alias("n")) for n in keys])


@query("j11_feature_pairs", f"WITH {PRICED_SQL} SELECT a.feature AS i, b.feature AS j, count(*) AS n, round(avg(a.value - b.value), 5) + 0.0 AS gap FROM priced a JOIN priced b ON a.entity = b.entity AND a.feature < b.feature GROUP BY 1, 2")
def j11(spark, d):
    from ..operators.ranking import entity_pairs

    p = entity_pairs(priced(spark, d), ["value"])
    return p.groupBy(F.col("x_feature").alias("i"), F.col("y_feature").alias("j")).agg(F.count(F.lit(1)).alias("n"), (F.round(F.avg(F.col("x_value") - F.col("y_value")), 5) + 0.0).alias("gap"))


@query("j13_panel_pairs", "SELECT a.r_name AS one, b.r_name AS other FROM region a JOIN region b ON a.r_regionkey < b.r_regionkey")
def j13(spark, d):
    r = table(spark, d, "region")
    return r.alias("a").join(r.alias("b"), F.col("a.r_regionkey") < F.col("b.r_regionkey")).select(F.col("a.r_name").alias("one"), F.col("b.r_name").alias("other"))


@query("j14_incident_edges", f"WITH {PRICED_SQL}, e AS (SELECT a.feature AS i, b.feature AS j, corr(a.value, b.value) AS r FROM priced a JOIN priced b ON a.entity = b.entity AND a.feature < b.feature GROUP BY 1, 2) SELECT q, count(*) AS edges, round(avg(r), 6) + 0.0 AS mean FROM (SELECT i AS q, r FROM e UNION ALL SELECT j, r FROM e) GROUP BY 1")
def j14(spark, d):
    e = G.mirrored(G.correlations(priced(spark, d), BRANDS))
    names = F.array(*[F.lit(b) for b in BRANDS])
    return e.groupBy(F.get(names, F.col("i")).alias("q")).agg(F.count(F.lit(1)).alias("edges"), (F.round(F.avg("r"), 6) + 0.0).alias("mean"))


@query("j18_match_precedence", """SELECT d.doc_id, coalesce(a.item_id, b.item_id) AS item_id, CASE WHEN a.item_id IS NOT NULL THEN 'whole' WHEN b.item_id IS NOT NULL THEN 'start' ELSE 'none' END AS method
FROM documents d LEFT JOIN (SELECT text, min(item_id) AS item_id FROM benchmark GROUP BY 1) a ON a.text = d.text
LEFT JOIN (SELECT substr(text, 1, 14) AS s, min(item_id) AS item_id FROM benchmark GROUP BY 1 HAVING count(*) = 1) b ON b.s = substr(d.text, 1, 14)""")
def j18(spark, d):
    b = table(spark, d, "benchmark")
    whole = b.groupBy(F.col("text").alias("w")).agg(F.min("item_id").alias("wid"))
    start = b.groupBy(F.substring("text", 1, 14).alias("s")).agg(F.min("item_id").alias("sid"), F.count(F.lit(1)).alias("c")).where("c = 1").drop("c")
    docs = table(spark, d, "documents").select("doc_id", "text", F.substring("text", 1, 14).alias("t14"))
    j = docs.join(whole, F.col("text") == F.col("w"), "left").join(start, F.col("t14") == F.col("s"), "left")
    return j.select("doc_id", F.coalesce("wid", "sid").alias("item_id"), F.when(F.col("wid").isNotNull(), "whole").when(F.col("sid").isNotNull(), "start").otherwise("none").alias("method"))


@query("a01_group_median", "SELECT user_id, event_type, round(median(value), 6) AS median FROM events GROUP BY 1, 2")
def a01(spark, d):
    return table(spark, d, "events").groupBy("user_id", "event_type").agg(F.round(F.median("value"), 6).alias("median"))


@query("a02_first_last", "SELECT user_id, min_by(event_type, ts::VARCHAR || lpad(event_id::VARCHAR, 12, '0')) AS first, max_by(event_type, ts::VARCHAR || lpad(event_id::VARCHAR, 12, '0')) AS last FROM events GROUP BY 1")
def a02(spark, d):
    e = table(spark, d, "events").withColumn("at", F.struct("ts", "event_id"))
    return A.first_last(e, ["user_id"], "event_type", "at")


@query("a04_pivot_median", "SELECT user_id AS entity, " + ", ".join(f"round(median(value) FILTER (WHERE event_type = '{t}'), 6) AS {t}" for t in ("click", "purchase", "view")) + " FROM events GROUP BY 1")
def a04(spark, d):
    g = table(spark, d, "events").groupBy(F.col("user_id").alias("entity")).pivot("event_type", ["click", "purchase", "view"]).agg(F.median("value"))
    return g.select("entity", *[F.round(t, 6).alias(t) for t in ("click", "purchase", "view")])


@query("a06_distinct_counts", "SELECT source, count(DISTINCT lang) AS langs, count(DISTINCT text) AS texts FROM documents GROUP BY 1")
def a06(spark, d):
    return table(spark, d, "documents").groupBy("source").agg(F.countDistinct("lang").alias("langs"), F.countDistinct("text").alias("texts"))


@query("a07_value_counts", "SELECT o_orderpriority, o_orderstatus, count(*) AS n FROM orders GROUP BY 1, 2")
def a07(spark, d):
    return table(spark, d, "orders").groupBy("o_orderpriority", "o_orderstatus").agg(F.count(F.lit(1)).alias("n"))


@query("a08_coverage", f"WITH {SPARSE_SQL}, n AS (SELECT entity, count(value) AS n FROM sparse GROUP BY 1) SELECT k::INTEGER AS least, count(*) FILTER (WHERE n >= k) AS entities FROM n CROSS JOIN (VALUES (5), (10), (15), (20), (25)) t(k) GROUP BY 1")
def a08(spark, d):
    return A.coverage(sparse(spark, d), [5, 10, 15, 20, 25])


@query("a09_sorted_sets", "SELECT source, array_to_string(list_sort(list(DISTINCT lang)), ' | ') AS langs FROM documents GROUP BY 1")
def a09(spark, d):
    return table(spark, d, "documents").groupBy("source").agg(F.array_join(F.array_sort(F.collect_set("lang")), " | ").alias("langs"))


@query("a10_largest_group", "SELECT n AS nation, s AS supplier, items FROM (SELECT s_nationkey AS n, s_suppkey AS s, count(DISTINCT l_partkey) AS items, row_number() OVER (PARTITION BY s_nationkey ORDER BY count(DISTINCT l_partkey) DESC, s_suppkey) AS k FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1, 2) WHERE k = 1")
def a10(spark, d):
    x = table(spark, d, "lineitem").select("l_suppkey", "l_partkey").join(table(spark, d, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    return A.largest_by(x, "s_nationkey", "s_suppkey", "l_partkey").select(F.col("s_nationkey").alias("nation"), F.col("s_suppkey").alias("supplier"), "items")


@query("a11_weighted_counts", "SELECT l_linenumber, round(sum(l_quantity), 6) AS weight, count(*) AS n FROM lineitem GROUP BY 1")
def a11(spark, d):
    return table(spark, d, "lineitem").groupBy("l_linenumber").agg(F.round(F.sum("l_quantity"), 6).alias("weight"), F.count(F.lit(1)).alias("n"))


@query("a12_balanced_mean", "WITH u AS (SELECT user_id, avg(value) AS m, sum(value) AS s, count(value) AS n FROM events GROUP BY 1) SELECT round(avg(m), 6) AS by_unit, round(sum(s) / sum(n), 6) AS pooled, count(*) AS units FROM u")
def a12(spark, d):
    return A.balanced_mean(table(spark, d, "events"), "user_id", "value").select(F.round("by_unit", 6).alias("by_unit"), F.round("pooled", 6).alias("pooled"), "units")


@query("a14_described", """SELECT event_type, count(value) AS n, round(avg(value), 6) AS mean, round(median(value), 6) AS median, round(coalesce(stddev_samp(value), 0), 6) AS sd,
round(quantile_cont(value, 0.025), 6) AS q025, round(quantile_cont(value, 0.05), 6) AS q05, round(quantile_cont(value, 0.95), 6) AS q95, round(quantile_cont(value, 0.975), 6) AS q975, round(min(value), 6) AS least, round(max(value), 6) AS greatest FROM events GROUP BY 1""")
def a14(spark, d):
    x = A.describe(table(spark, d, "events"), ["event_type"], "value")
    return x.select("event_type", "n", *[F.round(c, 6).alias(c) for c in x.columns[2:]])


@query("a15_spreads", f"WITH {DENSE_SQL} SELECT feature, round(stddev_samp(value), 8) AS sample, round(stddev_pop(value), 8) AS population FROM dense GROUP BY 1")
def a15(spark, d):
    return dense(spark, d).groupBy("feature").agg(F.round(F.stddev_samp("value"), 8).alias("sample"), F.round(F.stddev_pop("value"), 8).alias("population"))


@query("a16_mad_scales", "SELECT event_type, round(any_value(m), 6) AS median, round(CASE WHEN median(abs(value - m)) * 1.4826 < 1e-12 THEN 1 ELSE median(abs(value - m)) * 1.4826 END, 6) AS scale FROM (SELECT event_type, value, median(value) OVER (PARTITION BY event_type) AS m FROM events) GROUP BY 1")
def a16(spark, d):
    return A.mad_scale(table(spark, d, "events"), ["event_type"], "value").select("event_type", F.round("median", 6).alias("median"), F.round("scale", 6).alias("scale"))




@query("a18_spearman", f"SELECT count(*) AS n, round(corr(rx, ry), 8) AS rho FROM (SELECT {rank_sql('1', 'l_quantity')} AS rx, {rank_sql('1', 'l_extendedprice')} AS ry FROM lineitem)")
def a18(spark, d):
    return G.row_spearman(table(spark, d, "lineitem"), "l_quantity", "l_extendedprice").withColumn("rho", F.round("rho", 8))


_PAIR_SP = "b AS (SELECT x.feature AS i, y.feature AS j, x.value AS v, y.value AS w FROM sparse x JOIN sparse y ON x.entity = y.entity AND x.feature < y.feature)"


@query("a19_pairwise_spearman", f"WITH {SPARSE_SQL}, {_PAIR_SP}, r AS (SELECT i, j, {rank_sql('i, j', 'v')} AS rv, {rank_sql('i, j', 'w')} AS rw FROM b) SELECT i, j, count(*) AS n, round(corr(rv, rw), 6) + 0.0 AS rho FROM r GROUP BY 1, 2 HAVING count(*) >= 10")
def a19(spark, d):
    return G.rank_correlations(sparse(spark, d), 10, BRANDS).select("i", "j", "n", (F.round("rho", 6) + 0.0).alias("rho"))


@query("a20_pair_support", f"WITH {SPARSE_SQL}, {_PAIR_SP} SELECT i, j, count(*) AS n FROM b GROUP BY 1, 2")
def a20(spark, d):
    names = F.array(*[F.lit(b) for b in BRANDS])
    return G.correlations(sparse(spark, d), BRANDS, least=1).select(F.get(names, F.col("i")).alias("i"), F.get(names, F.col("j")).alias("j"), "n")


@query("a22_weighted_correlation", """WITH s AS (SELECT sum(l_quantity) AS w, sum(l_quantity * l_quantity) AS w2, sum(l_quantity * l_discount) / sum(l_quantity) AS mx, sum(l_quantity * l_tax) / sum(l_quantity) AS my,
sum(l_quantity * l_discount * l_tax) / sum(l_quantity) AS mxy, sum(l_quantity * l_discount * l_discount) / sum(l_quantity) AS mxx, sum(l_quantity * l_tax * l_tax) / sum(l_quantity) AS myy FROM lineitem)
SELECT round((mxy - mx * my) / (1 - w2 / w ** 2), 12) + 0.0 AS cov, round((mxy - mx * my) / sqrt((mxx - mx ** 2) * (myy - my ** 2)), 9) + 0.0 AS r FROM s""")
def a22(spark, d):
    return A.weighted_correlation(table(spark, d, "lineitem"), "l_discount", "l_tax", "l_quantity").select((F.round("cov", 12) + 0.0).alias("cov"), (F.round("r", 9) + 0.0).alias("r"))


@query("a23_group_moments", f"WITH {PRICED_SQL}, {GROUPS_SQL} SELECT g.grp, a.feature AS i, b.feature AS j, count(*)::DOUBLE AS n, round(sum(a.value), 6) AS sx, round(sum(b.value), 6) AS sy, round(sum(a.value * b.value), 6) AS sxy FROM priced a JOIN priced b ON a.entity = b.entity AND a.feature < b.feature JOIN grp g ON g.entity = a.entity GROUP BY 1, 2, 3")
def a23(spark, d):
    rows = G.rows_of(priced(spark, d).join(groups(spark, d), "entity"), BRANDS, ["grp"])
    names = F.array(*[F.lit(b) for b in BRANDS])
    m = G.pair_moments(rows, len(BRANDS), ["grp"]).where("n > 0")
    return m.select("grp", F.get(names, F.col("i")).alias("i"), F.get(names, F.col("j")).alias("j"), "n", F.round(S.total("x"), 6).alias("sx"), F.round(S.total("y"), 6).alias("sy"), F.round(S.product_sum(), 6).alias("sxy"))


@query("a25_effective_number", "WITH c AS (SELECT source, lang, count(*) AS c FROM documents GROUP BY 1, 2), t AS (SELECT *, sum(c) OVER (PARTITION BY source) AS t FROM c) SELECT source, round(exp(-sum(c / t * ln(c / t))), 6) AS effective FROM t GROUP BY 1")
def a25(spark, d):
    return A.effective_number(table(spark, d, "documents"), ["source"], "lang").select("source", F.round("effective", 6).alias("effective"))


@query("a26_profile_collisions", """WITH p AS (SELECT conv_id, list_sort(list(DISTINCT role || '/' || turn)) AS items FROM conversations GROUP BY 1), n AS (SELECT len(items)::INTEGER AS degree, items, count(*) AS c FROM p GROUP BY 1, 2)
SELECT degree, (sum(c) * (sum(c) - 1) / 2)::DOUBLE AS pairs, sum(c * (c - 1) / 2)::DOUBLE AS same FROM n GROUP BY 1""")
def a26(spark, d):
    e = table(spark, d, "conversations").select("conv_id", F.concat_ws("/", "role", "turn").alias("item"))
    return A.collisions(e, "conv_id", "item").select("degree", F.col("pairs").cast("double").alias("pairs"), F.col("same").cast("double").alias("same"))


@query("a27_degree_bins", "WITH d AS (SELECT conv_id, least(count(*), 6) AS degree FROM conversations GROUP BY 1), c AS (SELECT degree, count(*) AS entities FROM d GROUP BY 1) SELECT degree, entities, round(entities / sum(entities) OVER (), 9) AS share FROM c")
def a27(spark, d):
    return A.degree_bins(table(spark, d, "conversations"), "conv_id", 6).select("degree", "entities", F.round("share", 9).alias("share"))


@query("a28_union", "SELECT 'documents' AS kind, doc_id AS id, length(text) AS chars FROM documents UNION ALL SELECT 'benchmark', item_id, length(text) FROM benchmark")
def a28(spark, d):
    part = lambda t, k: table(spark, d, t).select(F.lit(t).alias("kind"), F.col(k).alias("id"), F.length("text").cast("long").alias("chars"))
    return part("documents", "doc_id").unionByName(part("benchmark", "item_id"))


@query("a29_kendall", """WITH x AS (SELECT l_linenumber AS x, l_quantity AS y, count(*) AS c FROM lineitem GROUP BY 1, 2), s AS (SELECT sum(a.c * b.c * sign(b.y - a.y)) AS s FROM x a JOIN x b ON a.x < b.x AND a.y <> b.y),
n AS (SELECT sum(c) * (sum(c) - 1) / 2 AS n0 FROM x), tx AS (SELECT sum(t * (t - 1) / 2) AS t FROM (SELECT sum(c) AS t FROM x GROUP BY x)), ty AS (SELECT sum(t * (t - 1) / 2) AS t FROM (SELECT sum(c) AS t FROM x GROUP BY y))
SELECT round(s.s / sqrt((n0 - tx.t) * (n0 - ty.t)), 9) + 0.0 AS tau FROM s, n, tx, ty""")
def a29(spark, d):
    return G.kendall(table(spark, d, "lineitem"), "l_linenumber", "l_quantity").select((F.round("tau", 9) + 0.0).alias("tau"))


@query("w02_percentile_ranks", f"WITH {PRICED_SQL}, r AS (SELECT entity, feature, {rank_sql('feature', 'score')} AS r, count(*) OVER (PARTITION BY feature) AS n FROM priced) SELECT entity, feature, round(r / n, 9) AS of_n, round((r - 0.5) / n, 9) AS mid, round((r - 1) / (n - 1), 9) AS closed FROM r")
def w02(spark, d):
    return W.percentile_ranks(priced(spark, d), "score", ["feature"]).select("entity", "feature", *[F.round(c, 9).alias(c) for c in ("of_n", "mid", "closed")])


@query("w03_row_ranks", f"WITH {PRICED_SQL} SELECT entity, feature, {rank_sql('entity', 'score')}::DOUBLE AS rank FROM priced")
def w03(spark, d):
    return priced(spark, d).select("entity", "feature", W.average_rank(["entity"], "score").alias("rank"))


_R = f"{PRICED_SQL}, e AS (SELECT a.feature AS i, b.feature AS j, round(corr(a.value, b.value), 6) AS r FROM priced a JOIN priced b ON a.entity = b.entity AND a.feature < b.feature GROUP BY 1, 2)"


def edges(spark, d):
    """Rounded correlations of the brands by name, and each pair's place in declared order."""
    names = F.array(*[F.lit(b) for b in BRANDS])
    e = G.correlations(priced(spark, d), BRANDS)
    return e.select(F.get(names, F.col("i")).alias("i"), F.get(names, F.col("j")).alias("j"), F.round("r", 6).alias("r"), (F.col("i") * len(BRANDS) + F.col("j")).alias("position"))


@query("w07_upper_tail", f"WITH {_R} SELECT i, j, (row_number() OVER (ORDER BY r DESC, i DESC, j DESC) <= greatest(1, ceil(count(*) OVER () * 0.1)))::INTEGER AS label FROM e")
def w07(spark, d):
    return W.upper_tail(edges(spark, d), "r", "position", 0.1).select("i", "j", "label")


@query("w08_upper_tail_first", f"WITH {_R} SELECT i, j, (row_number() OVER (ORDER BY r DESC, i, j) <= greatest(1, ceil(count(*) OVER () * 0.2)))::INTEGER AS label FROM e")
def w08(spark, d):
    return W.upper_tail(edges(spark, d), "r", "position", 0.2, later_wins=False).select("i", "j", "label")


@query("w09_replicated_labels", "WITH l AS (SELECT doc_id, quality + toxic + (n_chars > 2000)::INTEGER AS k FROM documents JOIN labels USING (doc_id)) SELECT doc_id, (k >= 2)::INTEGER AS label FROM l")
def w09(spark, d):
    x = table(spark, d, "documents").select("doc_id", "n_chars").join(table(spark, d, "labels"), "doc_id")
    return x.select("doc_id", (F.col("quality") + F.col("toxic") + (F.col("n_chars") > 2000).cast("int") >= 2).cast("int").alias("label"))


@query("w11_top_rows", "SELECT l_suppkey, l_orderkey, l_linenumber, l_extendedprice FROM (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber, l_partkey) AS k FROM lineitem) WHERE k <= 3")
def w11(spark, d):
    k = F.row_number().over(Window.partitionBy("l_suppkey").orderBy(F.desc("l_extendedprice"), "l_orderkey", "l_linenumber", "l_partkey"))
    return table(spark, d, "lineitem").withColumn("k", k).where("k <= 3").select("l_suppkey", "l_orderkey", "l_linenumber", "l_extendedprice")


@query("w12_arg_least", f"WITH {PRICED_SQL} SELECT entity, feature AS best FROM (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY score, feature) AS k FROM priced) WHERE k = 1")
def w12(spark, d):
    return priced(spark, d).groupBy("entity").agg(F.min_by("feature", F.struct("score", "feature")).alias("best"))


@query("w13_cumulative_share", "WITH v AS (SELECT source, count(*) AS n FROM documents GROUP BY 1) SELECT source, round(sum(n) OVER (ORDER BY n DESC, source ROWS UNBOUNDED PRECEDING) / sum(n) OVER (), 9) AS share FROM v")
def w13(spark, d):
    n = table(spark, d, "documents").groupBy("source").agg(F.count(F.lit(1)).alias("n"))
    run = Window.orderBy(F.desc("n"), "source").rowsBetween(Window.unboundedPreceding, 0)
    return n.select("source", F.round(F.sum("n").over(run) / F.sum("n").over(Window.partitionBy()), 9).alias("share"))


@query("w16_quantile_bins", "WITH q AS (SELECT quantile_cont(o_totalprice, 0.25) AS a, quantile_cont(o_totalprice, 0.5) AS b, quantile_cont(o_totalprice, 0.75) AS c FROM orders) SELECT (CASE WHEN o_totalprice <= a THEN 0 WHEN o_totalprice <= b THEN 1 WHEN o_totalprice <= c THEN 2 ELSE 3 END)::INTEGER AS bin, count(*) AS n FROM orders, q GROUP BY 1")
def w16(spark, d):
    return W.quantile_bins(table(spark, d, "orders").select("o_totalprice"), "o_totalprice", 4).groupBy("bin").agg(F.count(F.lit(1)).alias("n"))


@query("w17_extremes", "WITH q AS (SELECT quantile_cont(o_totalprice, 0.1) AS a, quantile_cont(o_totalprice, 0.9) AS b FROM orders) SELECT o_orderkey, (CASE WHEN o_totalprice <= a THEN -1 WHEN o_totalprice >= b THEN 1 ELSE 0 END)::INTEGER AS side FROM orders, q")
def w17(spark, d):
    return W.extremes(table(spark, d, "orders").select("o_orderkey", "o_totalprice"), "o_totalprice", 0.1).select("o_orderkey", "side")


@query("w20_set_counts", """WITH a AS (SELECT DISTINCT l_partkey AS k FROM lineitem WHERE l_returnflag = 'R'), b AS (SELECT DISTINCT l_partkey AS k FROM lineitem WHERE l_tax > 0.07),
c AS (SELECT (SELECT count(*) FROM a) AS a, (SELECT count(*) FROM b) AS b, (SELECT count(*) FROM a JOIN b USING (k)) AS s) SELECT s AS shared, a + b - s AS either, a - s AS only_a, b - s AS only_b, round(s / (a + b - s), 9) AS jaccard FROM c""")
def w20(spark, d):
    x = table(spark, d, "lineitem").select(F.col("l_partkey").alias("k"), "l_returnflag", "l_tax")
    return W.set_counts(x.where("l_returnflag = 'R'"), x.where("l_tax > 0.07"), "k").withColumn("jaccard", F.round("jaccard", 9))


@query("w21_shared_by_all", "SELECT l_partkey FROM lineitem WHERE l_returnflag = 'R' INTERSECT SELECT l_partkey FROM lineitem WHERE l_linestatus = 'O' INTERSECT SELECT l_partkey FROM lineitem WHERE l_discount > 0.09")
def w21(spark, d):
    x = table(spark, d, "lineitem")
    return reduce(lambda a, b: a.intersect(b), [x.where(c).select("l_partkey") for c in ("l_returnflag = 'R'", "l_linestatus = 'O'", "l_discount > 0.09")])


@query("w23_set_difference", "SELECT l_partkey FROM lineitem WHERE l_returnflag = 'R' EXCEPT SELECT l_partkey FROM lineitem WHERE l_discount > 0.09")
def w23(spark, d):
    x = table(spark, d, "lineitem")
    return x.where("l_returnflag = 'R'").select("l_partkey").subtract(x.where("l_discount > 0.09").select("l_partkey"))


@query("w24_threshold_grid", "SELECT t::DOUBLE AS threshold, flag, count(*) FILTER (WHERE l_discount >= t) AS n FROM (SELECT l_discount, l_returnflag AS flag FROM lineitem) CROSS JOIN (VALUES (0.02), (0.05), (0.08)) g(t) GROUP BY 1, 2")
def w24(spark, d):
    steps = [0.02, 0.05, 0.08]
    counts = F.array(*[F.struct(F.lit(t).alias("threshold"), F.count_if(F.col("l_discount") >= t).alias("n")) for t in steps])
    n = table(spark, d, "lineitem").groupBy(F.col("l_returnflag").alias("flag")).agg(counts.alias("c"))
    return n.select("flag", F.explode("c").alias("c")).select("flag", "c.threshold", "c.n")


@query("w25_selection_stability", """WITH s AS (SELECT DISTINCT l_linenumber AS fold, l_suppkey AS item FROM lineitem WHERE l_quantity >= 49), p AS (SELECT a.fold AS f, b.fold AS g, count(*) AS s FROM s a JOIN s b ON a.item = b.item AND a.fold < b.fold GROUP BY 1, 2), n AS (SELECT fold, count(*) AS n FROM s GROUP BY 1)
SELECT f, g, round(s / (x.n + y.n - s), 9) AS jaccard FROM p JOIN n x ON x.fold = f JOIN n y ON y.fold = g""")
def w25(spark, d):
    s = table(spark, d, "lineitem").where("l_quantity >= 49").select(F.col("l_linenumber").alias("fold"), F.col("l_suppkey").alias("item")).distinct()
    n = s.groupBy("fold").agg(F.count(F.lit(1)).alias("n"))
    p = s.alias("a").join(s.alias("b"), "item").where("a.fold < b.fold").groupBy(F.col("a.fold").alias("f"), F.col("b.fold").alias("g")).agg(F.count(F.lit(1)).alias("s"))
    x, y = n.select(F.col("fold").alias("f"), F.col("n").alias("nx")), n.select(F.col("fold").alias("g"), F.col("n").alias("ny"))
    return p.join(x, "f").join(y, "g").select("f", "g", F.round(F.col("s") / (F.col("nx") + F.col("ny") - F.col("s")), 9).alias("jaccard"))


_MASK = " + ".join(f"max((feature = '{b}')::INTEGER) * {1 << i}" for i, b in enumerate(BRANDS))


@query("w26_largest_rectangle", f"""WITH RECURSIVE {SPARSE_SQL}, m AS (SELECT mask, count(*) AS c FROM (SELECT entity, ({_MASK})::BIGINT AS mask FROM sparse GROUP BY 1) GROUP BY 1), f AS (SELECT unnest(range({len(BRANDS)})) AS k),
s AS (SELECT 0::BIGINT AS chosen, -1::BIGINT AS last, sum(c)::BIGINT AS entities FROM m UNION ALL SELECT chosen | (1::BIGINT << k) AS chosen, k AS last, sum(c)::BIGINT AS entities FROM s JOIN f ON k > last JOIN m ON (mask & (chosen | (1::BIGINT << k))) = (chosen | (1::BIGINT << k)) GROUP BY ALL HAVING sum(c) >= 20)
SELECT bit_count(chosen)::INTEGER AS features, entities, reverse(lpad(bin(chosen), {len(BRANDS)}, '0')) AS members FROM s ORDER BY 1 DESC, 2 DESC, 3 DESC LIMIT 1""")
def w26(spark, d):
    """Of all brands the most that at least twenty suppliers sell together in large lines."""
    return largest_complete(sparse(spark, d), BRANDS, 20)
