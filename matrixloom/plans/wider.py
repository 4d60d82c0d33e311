"""Queries: matched arms, shared-draw bootstraps, pooled and class-balanced models, fingerprints, ledgers, and tables that go through files."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import geometry as G
from ..operators import moments as S
from ..operators import ranks as W
from ..operators import resample as B
from ..sources import files, sinks
from ..sources.tables import scratch, table
from .base import BRANDS, PRICED_SQL, priced, query, rank_sql, uniform_sql
from .matrices import _pairs, _rounded

_EDGES = f"{PRICED_SQL}, e AS ({_pairs('priced')})"
_MOMENTS_SQL = "SELECT a.feature AS i, b.feature AS j, count(*)::DOUBLE AS n, covar_samp(a.value, b.value) AS c, corr(a.value, b.value) AS r FROM priced a JOIN priced b ON a.entity = b.entity AND a.feature < b.feature GROUP BY 1, 2"


def _named(pairs, *values):
    names = F.array(*map(F.lit, BRANDS))
    return pairs.select(F.get(names, F.col("i")).alias("i"), F.get(names, F.col("j")).alias("j"), *values)


def _brand_pairs(cells, group=None):
    e = G.correlations(cells, BRANDS, group)
    names = F.array(*map(F.lit, BRANDS))
    return e.select(*(group or []), F.get(names, F.col("i")).alias("i"), F.get(names, F.col("j")).alias("j"), "r")


# Pivots, moments and ranks

@query("a03_pivoted", f"WITH {PRICED_SQL} SELECT entity, " + ", ".join(f"max(value) FILTER (WHERE feature = '{b}') AS b{b[6:]}" for b in BRANDS) + " FROM priced GROUP BY 1")
def a03(spark, d):
    """Suppliers by brands, a column for each brand; a cell that is there twice would raise before."""
    x = priced(spark, d).groupBy("entity").pivot("feature", BRANDS).agg(F.max("value"))
    return x.select("entity", *[F.col(f"`{b}`").alias(f"b{b[6:]}") for b in BRANDS])


@query("a21_covariances", f"WITH {PRICED_SQL}, m AS ({_MOMENTS_SQL}) SELECT i, j, round(c, 8) + 0.0 AS c FROM m")
def a21(spark, d):
    m = G.pair_moments(G.rows_of(priced(spark, d), BRANDS), len(BRANDS)).where("n > 1")
    return _named(m, (F.round(G.covariance(), 8) + 0.0).alias("c"))


@query("a24_from_moments", f"WITH {PRICED_SQL}, m AS ({_MOMENTS_SQL}) SELECT i, j, n::BIGINT AS n, round(r, 6) + 0.0 AS r FROM m")
def a24(spark, d):
    m = G.pair_moments(G.rows_of(priced(spark, d), BRANDS), len(BRANDS))
    return _named(m, F.col("n").cast("long").alias("n"), (F.round(G.correlation(), 6) + 0.0).alias("r"))


@query("w01_average_ranks", f"SELECT DISTINCT l_returnflag AS flag, l_extendedprice AS price, {rank_sql('l_returnflag', 'l_extendedprice')}::DOUBLE AS rank FROM lineitem")
def w01(spark, d):
    """Average rank of every price within its flag, by ranges of values: no task holds a flag."""
    x = table(spark, d, "lineitem").select(F.col("l_returnflag").alias("flag"), F.col("l_extendedprice").alias("price"))
    return W.value_ranks(x, "price", ["flag"]).withColumn("rank", F.col("rank").cast("double"))


@query("n22_holm", "WITH s AS (SELECT l_suppkey AS k, abs(corr(l_quantity, l_extendedprice)) AS r FROM lineitem GROUP BY 1), p AS (SELECT k, round(1 - r, 9) AS p FROM s), h AS (SELECT k, p, least(1.0, p * (count(*) OVER () - row_number() OVER (ORDER BY p, k) + 1)) AS raw FROM p) SELECT k, round(max(raw) OVER (ORDER BY p, k ROWS UNBOUNDED PRECEDING), 8) AS adjusted FROM h")
def n22(spark, d):
    p = table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("k")).agg(F.round(1 - F.abs(F.corr("l_quantity", "l_extendedprice")), 9).alias("p"))
    return W.holm(p, "p", "k").select("k", F.round("adjusted", 8).alias("adjusted"))


# Geometry

@query("g02_symmetric", f"WITH {_EDGES}, s AS (SELECT i, j, r FROM e UNION ALL SELECT j, i, r FROM e UNION ALL SELECT DISTINCT feature, feature, 1.0 FROM priced) SELECT i, j, round(r, 6) + 0.0 AS r FROM s")
def g02(spark, d):
    c = priced(spark, d)
    own = c.select(F.col("feature").alias("i"), F.col("feature").alias("j"), F.lit(1.0).alias("r")).distinct()
    return _rounded(G.mirrored(_brand_pairs(c)).union(own), 6, "r")


@query("g04_moment_identity", f"WITH {_EDGES} SELECT round(25.0 / (1 + 24 * avg(r * r)), 6) AS from_mean, round(625.0 / (25 + 2 * sum(r * r)), 6) AS from_sum FROM e")
def g04(spark, d):
    q = F.col("r") * F.col("r")
    return _brand_pairs(priced(spark, d)).agg(F.round(25.0 / (1 + 24 * F.avg(q)), 6).alias("from_mean"), F.round(625.0 / (25 + 2 * F.sum(q)), 6).alias("from_sum"))


@query("g22_fingerprint_retrieval", f"""WITH {PRICED_SQL}, c AS (SELECT entity % 2 AS part, p.* FROM priced p), o AS (SELECT a.part, a.feature AS f, b.feature AS k, corr(a.value, b.value) AS r FROM c a JOIN c b ON a.entity = b.entity AND a.feature <> b.feature GROUP BY 1, 2, 3),
t AS (SELECT u.f, v.f AS g, round(avg((u.r - v.r) ** 2), 10) AS t FROM o u JOIN o v ON u.k = v.k AND u.part = 0 AND v.part = 1 WHERE u.k <> v.f AND v.k <> u.f GROUP BY 1, 2) SELECT f AS feature, rank::INTEGER AS rank FROM (SELECT f, g, rank() OVER (PARTITION BY f ORDER BY t) AS rank FROM t) WHERE f = g""")
def g22(spark, d):
    """For each brand, where its own fingerprint in one half of suppliers ranks among all brands' fingerprints in the other half."""
    e = _brand_pairs(priced(spark, d).withColumn("part", F.col("entity") % 2), ["part"])
    o = e.select("part", F.col("i").alias("f"), F.col("j").alias("k"), "r").union(e.select("part", "j", "i", "r"))
    u, v = o.where("part = 0").select("f", "k", F.col("r").alias("u")), o.where("part = 1").select(F.col("f").alias("g"), "k", F.col("r").alias("v"))
    t = u.join(v, "k").where("k <> g AND k <> f").groupBy("f", "g").agg(F.round(F.avg((F.col("u") - F.col("v")) ** 2), 10).alias("t"))
    own = t.where("f = g").select(F.col("f").alias("feature"), F.col("t").alias("own"))
    return t.join(own, F.col("f") == F.col("feature")).groupBy("feature").agg((F.count_if(F.col("t") < F.col("own")) + 1).cast("int").alias("rank"))


@query("g25_library_diversity", "WITH x AS (SELECT s_nationkey AS library, l_suppkey AS k, p_brand AS brand FROM lineitem JOIN part ON p_partkey = l_partkey JOIN supplier ON s_suppkey = l_suppkey), n AS (SELECT library, brand, count(*) AS c FROM x GROUP BY 1, 2), m AS (SELECT library, count(DISTINCT k) AS members FROM x GROUP BY 1), t AS (SELECT library, sum(c) AS t, sum(c * ln(c)) AS cl, count(*) AS brands FROM n GROUP BY 1) SELECT library, members, brands, round(exp(ln(t) - cl / t), 6) AS effective, round(t / members, 6) AS hits FROM t JOIN m USING (library)")
def g25(spark, d):
    """For each nation's suppliers: how many, over how many brands their lines go, the effective number of brands, and lines a supplier."""
    s = table(spark, d, "supplier").select(F.col("s_suppkey").alias("k"), F.col("s_nationkey").alias("library"))
    p = table(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_brand").alias("brand"))
    x = table(spark, d, "lineitem").select("l_partkey", F.col("l_suppkey").alias("k")).join(p, "l_partkey").join(s, "k")
    each = x.groupBy("library", "k", "brand").agg(F.count(F.lit(1)).alias("c"))
    m = each.select("library", "k").distinct().groupBy("library").agg(F.count(F.lit(1)).alias("members"))
    n = each.groupBy("library", "brand").agg(F.sum("c").alias("c"))
    t = n.groupBy("library").agg(F.sum("c").alias("t"), F.sum(F.col("c") * F.log("c")).alias("cl"), F.count(F.lit(1)).alias("brands"))
    return t.join(m, "library").select("library", "members", "brands", F.round(F.exp(F.log("t") - F.col("cl") / F.col("t")), 6).alias("effective"), F.round(F.col("t") / F.col("members"), 6).alias("hits"))


@query("g28_covariate_association", f"WITH {_EDGES}, p AS (SELECT p_brand AS b, round(avg(p_retailprice), 6) AS a FROM part GROUP BY 1), x AS (SELECT round(abs(r), 9) AS s, round(abs(u.a - v.a), 6) AS t FROM e JOIN p u ON u.b = i JOIN p v ON v.b = j), k AS (SELECT {rank_sql('1', 's')} AS s, {rank_sql('1', 't')} AS t FROM x) SELECT count(*) AS n, round(corr(s, t), 6) + 0.0 AS rho FROM k")
def g28(spark, d):
    """Rank correlation of the strength of a pair of brands with how far their mean prices lie apart."""
    p = table(spark, d, "part").groupBy("p_brand").agg(F.round(F.avg("p_retailprice"), 6).alias("a"))
    u, v = p.select(F.col("p_brand").alias("i"), F.col("a").alias("u")), p.select(F.col("p_brand").alias("j"), F.col("a").alias("v"))
    x = _brand_pairs(priced(spark, d)).join(u, "i").join(v, "j").select(F.round(F.abs("r"), 9).alias("s"), F.round(F.abs(F.col("u") - F.col("v")), 6).alias("t"))
    return _rounded(G.spearman(x, "s", "t"), 6, "rho")


@query("g29_without_parts", f"""WITH {PRICED_SQL}, c AS (SELECT k::INTEGER AS without, p.* FROM priced p CROSS JOIN range(4) t(k) WHERE entity % 4 <> k), e AS (SELECT a.without, a.feature AS i, b.feature AS j, corr(a.value, b.value) AS r FROM c a JOIN c b ON a.entity = b.entity AND a.without = b.without AND a.feature < b.feature GROUP BY 1, 2, 3) SELECT without, round(625.0 / (25 + 2 * sum(r * r)), 6) AS pr FROM e GROUP BY 1""")
def g29(spark, d):
    """Participation ratio with each quarter of the reference suppliers left out."""
    c = priced(spark, d).withColumn("without", F.explode(F.array(*[F.lit(k) for k in range(4)]))).where("entity % 4 <> without")
    return G.participation(_brand_pairs(c, ["without"]), 25, ["without"]).select("without", F.round("pr", 6).alias("pr"))


# Nulls, arms and bootstraps

_FACTOR = "SELECT l_suppkey AS k, sum(l_discount) AS s, sum(l_tax) AS t, count(*) AS n FROM lineitem GROUP BY 1"
#: Cumulated probabilities of a Poisson count with mean 1.
_POISSON = [0.36787944117144233, 0.7357588823428847, 0.9196986029286058, 0.9810118431238462, 0.9963401531726563, 0.9994058151824183, 0.9999167588507119, 0.9999897508033253]
_TIMES = "(" + " + ".join("(u > {})::INTEGER".format(p) for p in _POISSON) + ")"


def _draws(df, count, seed, key="k"):
    return df.withColumn("replicate", F.explode(F.sequence(F.lit(0), F.lit(count - 1)))).withColumn("u", B.uniform(seed, F.col("replicate"), F.col(key)))


def _times():
    return sum(((F.col("u") > p).cast("int") for p in _POISSON), F.lit(0))


def _suppliers(spark, d):
    return table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("k")).agg(F.sum("l_discount").alias("s"), F.sum("l_tax").alias("t"), F.count(F.lit(1)).alias("n"))


@query("b05_exponential_weights", f"WITH f AS ({_FACTOR}), w AS (SELECT replicate, s, n, -ln({uniform_sql("'51'", 'replicate', 'k')}) AS w FROM f CROSS JOIN (SELECT unnest(range(20)) AS replicate)) SELECT replicate::INTEGER AS replicate, round(sum(w * s) / sum(w * n), 10) AS mean FROM w GROUP BY 1")
def b05(spark, d):
    """Mean discount under exponential weights of suppliers."""
    w = _draws(_suppliers(spark, d), 20, 51).withColumn("w", -F.log("u"))
    return w.groupBy("replicate").agg(F.round(F.sum(F.col("w") * F.col("s")) / F.sum(F.col("w") * F.col("n")), 10).alias("mean"))


@query("b03_shared_draws", f"WITH f AS ({_FACTOR}), w AS (SELECT replicate, s, t, n, -ln({uniform_sql("'52'", 'replicate', 'k')}) AS w FROM f CROSS JOIN (SELECT unnest(range(20)) AS replicate)) SELECT replicate::INTEGER AS replicate, round(sum(w * s) / sum(w * n), 10) AS one, round(sum(w * t) / sum(w * n), 10) AS other, round(sum(w * (s - t)) / sum(w * n), 10) AS difference FROM w GROUP BY 1")
def b03(spark, d):
    """Two means and their difference under the same weights, from each supplier's sums: rows are read once."""
    w = _draws(_suppliers(spark, d), 20, 52).withColumn("w", -F.log("u"))
    mean = lambda c, n: F.round(F.sum(F.col("w") * c) / F.sum(F.col("w") * F.col("n")), 10).alias(n)
    return w.groupBy("replicate").agg(mean(F.col("s"), "one"), mean(F.col("t"), "other"), mean(F.col("s") - F.col("t"), "difference"))


@query("b06_multiplicities", f"WITH f AS ({_FACTOR}), w AS (SELECT replicate, s, n, {uniform_sql("'53'", 'replicate', 'k')} AS u FROM f CROSS JOIN (SELECT unnest(range(20)) AS replicate)) SELECT replicate::INTEGER AS replicate, sum({_TIMES})::BIGINT AS clusters, round(sum({_TIMES} * s) / sum({_TIMES} * n), 10) AS mean FROM w GROUP BY 1")
def b06(spark, d):
    """Mean discount where each supplier counts as often as it is drawn: a Poisson number of times."""
    w = _draws(_suppliers(spark, d), 20, 53).withColumn("w", _times())
    return w.groupBy("replicate").agg(F.sum("w").cast("long").alias("clusters"), F.round(F.sum(F.col("w") * F.col("s")) / F.sum(F.col("w") * F.col("n")), 10).alias("mean"))


_SUMS = "SELECT l_suppkey AS k, count(*) AS n, sum(l_quantity) AS x, sum(l_extendedprice) AS y, sum(l_quantity * l_quantity) AS xx, sum(l_quantity * l_extendedprice) AS xy FROM lineitem GROUP BY 1"


@query("b22_refit_slopes", f"WITH f AS ({_SUMS}), w AS (SELECT f.*, replicate, {uniform_sql("'54'", 'replicate', 'k')} AS u FROM f CROSS JOIN (SELECT unnest(range(20)) AS replicate)), t AS (SELECT replicate, sum({_TIMES} * n) AS n, sum({_TIMES} * x) AS x, sum({_TIMES} * y) AS y, sum({_TIMES} * xx) AS xx, sum({_TIMES} * xy) AS xy FROM w GROUP BY 1) SELECT replicate::INTEGER AS replicate, round((xy - x * y / n) / (xx - x * x / n), 4) AS slope FROM t")
def b22(spark, d):
    """Slope of price on quantity refitted to each draw of suppliers, from their moments."""
    q, p = F.col("l_quantity"), F.col("l_extendedprice")
    lines = table(spark, d, "lineitem")
    f = lines.groupBy(F.col("l_suppkey").alias("k")).agg(F.count(F.lit(1)).alias("n"), F.avg(q).alias("mx"), F.avg(p).alias("my"), F.regr_sxx(p, q).alias("cxx"), F.regr_syy(p, q).alias("cyy"), F.regr_sxy(p, q).alias("cxy"), F.lit(0.0).alias("lx"), F.lit(0.0).alias("ly"))
    near = F.broadcast(lines.agg(F.avg(q).alias("ox"), F.avg(p).alias("oy")))
    t = S.merged(S.weighted(_draws(f, 20, 54).withColumn("w", _times()).join(near), F.col("w")), ["replicate"], ("ox", "oy"))
    return t.select("replicate", F.round(F.col("cxy") / F.col("cxx"), 4).alias("slope"))


@query("b18_repeated_samples", f"WITH x AS (SELECT replicate, toxic, n_chars FROM documents JOIN labels USING (doc_id) CROSS JOIN (SELECT unnest(range(10)) AS replicate) WHERE {uniform_sql("'55'", 'replicate', 'doc_id')} < 0.5) SELECT replicate::INTEGER AS replicate, count(*) AS n, round(avg(toxic), 9) AS toxic, round(avg(n_chars), 6) AS n_chars FROM x GROUP BY 1")
def b18(spark, d):
    """Shares and means in ten halves of all labelled documents."""
    x = table(spark, d, "documents").select("doc_id", "n_chars").join(table(spark, d, "labels").select("doc_id", "toxic"), "doc_id")
    s = _draws(x, 10, 55, "doc_id").where("u < 0.5")
    return s.groupBy("replicate").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("toxic"), 9).alias("toxic"), F.round(F.avg("n_chars"), 6).alias("n_chars"))


@query("b20_matched_references", "WITH c AS (SELECT l_returnflag AS flag, l_quantity AS q, row_number() OVER (PARTITION BY l_returnflag ORDER BY sha256('56|' || l_orderkey || '|' || l_linenumber || '|' || l_partkey || '|' || l_suppkey)) AS k FROM lineitem), m AS (SELECT min(n) AS m FROM (SELECT count(*) AS n FROM lineitem GROUP BY l_returnflag)) SELECT flag, count(*) AS n, round(avg(q), 8) AS mean FROM c, m WHERE k <= m GROUP BY 1")
def b20(spark, d):
    """Mean quantity of each flag over as many lines as the rarest flag has, taken in hash order."""
    h = F.sha2(F.concat_ws("|", F.lit("56"), *[F.col(c).cast("string") for c in ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")]), 256)
    x = table(spark, d, "lineitem").select(F.col("l_returnflag").alias("flag"), F.col("l_quantity").alias("q"), h.alias("h"))
    least = x.groupBy("flag").agg(F.count(F.lit(1)).alias("n")).agg(F.min("n").alias("m"))
    return W.numbered(x, ["flag"], "h").join(F.broadcast(least)).where("k < m").groupBy("flag").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("q"), 8).alias("mean"))


@query("n18_matched_arms", "WITH x AS (SELECT doc_id, n_chars, toxic FROM documents JOIN labels USING (doc_id)), s AS (SELECT sum(toxic) AS m FROM x), r AS (SELECT replicate, n_chars, row_number() OVER (PARTITION BY replicate ORDER BY sha256('57|' || replicate || '|' || doc_id)) AS k FROM x CROSS JOIN (SELECT unnest(range(10)) AS replicate)) SELECT replicate::INTEGER AS replicate, count(*) AS n, round(avg(n_chars), 6) AS mean FROM r, s WHERE k <= m GROUP BY 1")
def n18(spark, d):
    """Mean length of random arms of as many labelled documents as are toxic."""
    x = table(spark, d, "documents").select("doc_id", "n_chars").join(table(spark, d, "labels").select("doc_id", "toxic"), "doc_id")
    each = x.withColumn("replicate", F.explode(F.sequence(F.lit(0), F.lit(9))))
    each = each.withColumn("h", F.sha2(F.concat_ws("|", F.lit("57"), F.col("replicate").cast("string"), F.col("doc_id").cast("string")), 256))
    size = x.agg(F.sum("toxic").alias("m"))
    return W.numbered(each, ["replicate"], "h").join(F.broadcast(size)).where("k < m").groupBy("replicate").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("n_chars"), 6).alias("mean"))


@query("n19_slope_null", "WITH x AS (SELECT s_suppkey AS k, s_acctbal AS a, n FROM supplier JOIN (SELECT l_suppkey, count(*) AS n FROM lineitem GROUP BY 1) ON l_suppkey = s_suppkey), o AS (SELECT replicate, a, n, row_number() OVER (PARTITION BY replicate ORDER BY sha256('58|' || k)) AS own, row_number() OVER (PARTITION BY replicate ORDER BY CASE WHEN replicate = 0 THEN sha256('58|' || k) ELSE sha256('58|' || replicate || '|' || k) END) AS new FROM x CROSS JOIN (SELECT unnest(range(20)) AS replicate)) SELECT u.replicate::INTEGER AS replicate, round(regr_slope(v.n, u.a), 10) + 0.0 AS slope FROM o u JOIN o v ON u.replicate = v.replicate AND u.own = v.new GROUP BY 1")
def n19(spark, d):
    """Slope of a supplier's lines on its balance, and after lines are dealt anew; replicate 0 is the observed one."""
    n = table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("s_suppkey")).agg(F.count(F.lit(1)).alias("n"))
    x = table(spark, d, "supplier").select("s_suppkey", F.col("s_acctbal").alias("a")).join(n, "s_suppkey").withColumn("replicate", F.explode(F.sequence(F.lit(0), F.lit(19))))
    own = B.hash_order(F.col("s_suppkey"), 58)
    new = F.when(F.col("replicate") == 0, own).otherwise(F.sha2(F.concat_ws("|", F.lit("58"), F.col("replicate").cast("string"), F.col("s_suppkey").cast("string")), 256))
    left = W.numbered(x.select("replicate", "a", own.alias("h")), ["replicate"], "h").select("replicate", "a", "k")
    right = W.numbered(x.select("replicate", "n", new.alias("h")), ["replicate"], "h").select("replicate", "n", "k")
    return left.join(right, ["replicate", "k"]).groupBy("replicate").agg((F.round(F.regr_slope("n", "a"), 10) + 0.0).alias("slope"))


@query("r18_paired_contrast", f"WITH {PRICED_SQL}, x AS (SELECT entity, avg(value) - avg(measured - score) AS d FROM priced GROUP BY 1) SELECT count(*) AS n, round(avg(d), 9) AS mean, round(stddev_samp(d) / sqrt(count(*)), 9) AS error, round(2.8015852 * stddev_samp(d) / sqrt(count(*)), 8) AS detectable FROM x")
def r18(spark, d):
    """Mean paired difference of two scorings, its error, and the least effect that a two-sided test at 5 percent finds with power 0.8."""
    x = priced(spark, d).groupBy("entity").agg((F.avg("value") - F.avg(F.col("measured") - F.col("score"))).alias("d"))
    error = F.stddev_samp("d") / F.sqrt(F.count(F.lit(1)))
    return x.agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("d"), 9).alias("mean"), F.round(error, 9).alias("error"), F.round(2.8015852 * error, 8).alias("detectable"))


# Models

@query("d03_shared_slopes", f"WITH {PRICED_SQL}, f AS (SELECT feature, regr_sxx(value, score) AS xx, regr_syy(value, score) AS yy, regr_sxy(value, score) AS xy FROM priced GROUP BY 1) SELECT round(1 - (sum(yy) - sum(xy) ** 2 / sum(xx)) / sum(yy), 8) AS shared, round(1 - sum(yy - xy ** 2 / xx) / sum(yy), 8) AS own FROM f")
def d03(spark, d):
    """Share of the variance within features that one slope for all explains, and that a slope for each explains."""
    f = priced(spark, d).groupBy("feature").agg(F.regr_sxx("value", "score").alias("xx"), F.regr_syy("value", "score").alias("yy"), F.regr_sxy("value", "score").alias("xy"))
    total = F.sum("yy")
    return f.agg(F.round(1 - (total - F.sum("xy") ** 2 / F.sum("xx")) / total, 8).alias("shared"), F.round(1 - F.sum(F.col("yy") - F.col("xy") ** 2 / F.col("xx")) / total, 8).alias("own"))


@query("d09_balanced_ridge", "WITH x AS (SELECT quality AS y, n_chars / 1000 AS x FROM documents JOIN labels USING (doc_id)), c AS (SELECT y, (SELECT count(*) FROM x) / (2.0 * count(*)) AS w FROM x GROUP BY 1), s AS (SELECT sum(w) AS w, sum(w * x) AS x, sum(w * y) AS y, sum(w * x * x) AS xx, sum(w * x * y) AS xy FROM x JOIN c USING (y)), b AS (SELECT *, (xy - x * y / w) / (xx - x * x / w + 1) AS b FROM s) SELECT round(b, 9) AS slope, round(y / w - b * x / w, 9) AS intercept FROM b")
def d09(spark, d):
    """Ridge regression of a label on length with classes weighted to equal sums, from their moments."""
    x = table(spark, d, "documents").select("doc_id", (F.col("n_chars") / 1000).alias("x")).join(table(spark, d, "labels").select("doc_id", F.col("quality").alias("y")), "doc_id")
    none = F.lit(0.0)
    c = x.groupBy("y").agg(F.count(F.lit(1)).alias("n"), F.avg("x").alias("mx"), F.avg("y").alias("my"), (F.var_pop("x") * F.count(F.lit(1))).alias("cxx"), none.alias("cyy"), none.alias("cxy"), none.alias("lx"), none.alias("ly"))
    w = c.join(F.broadcast(c.agg(F.sum("n").alias("all"))))
    s = S.merged(S.weighted(w, F.col("all") / (2 * F.col("n"))), [])
    b = F.col("cxy") / (F.col("cxx") + 1)
    return s.select(F.round(b, 9).alias("slope"), F.round(F.col("my") - b * F.col("mx"), 9).alias("intercept"))


@query("d22_basis", "WITH r AS (SELECT corr(l_quantity, l_extendedprice) AS a, corr(l_quantity, l_tax) AS b, corr(l_extendedprice, l_tax) AS c FROM lineitem) SELECT round(1 - a * a - b * b - c * c + 2 * a * b * c, 9) AS determinant, round(greatest(abs(a), abs(b), abs(c)), 9) AS closest, round((1 - c * c) / (1 - a * a - b * b - c * c + 2 * a * b * c), 6) AS inflation FROM r")
def d22(spark, d):
    """Of three descriptors: determinant of their correlations, the closest two, and the first one's variance inflation."""
    r = table(spark, d, "lineitem").agg(F.corr("l_quantity", "l_extendedprice").alias("a"), F.corr("l_quantity", "l_tax").alias("b"), F.corr("l_extendedprice", "l_tax").alias("c"))
    a, b, c = F.col("a"), F.col("b"), F.col("c")
    det = 1 - a * a - b * b - c * c + 2 * a * b * c
    return r.select(F.round(det, 9).alias("determinant"), F.round(F.greatest(F.abs(a), F.abs(b), F.abs(c)), 9).alias("closest"), F.round((1 - c * c) / det, 6).alias("inflation"))


# Contracts, ledgers, files

@query("j08_positions", "WITH a AS (SELECT o_orderkey AS k FROM orders), b AS (SELECT DISTINCT l_orderkey AS k FROM lineitem) SELECT (SELECT count(*) FROM a) AS n_left, (SELECT count(*) FROM b) AS n_right, (SELECT count(*) FROM a FULL JOIN b ON a.k = b.k WHERE a.k IS NULL OR b.k IS NULL) AS unmatched")
def j08(spark, d):
    """Whether two sorted key columns agree place by place, which unique keys do just if none is without a match."""
    a = table(spark, d, "orders").select(F.col("o_orderkey").alias("k"), F.lit(1).alias("a"))
    b = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("k")).distinct().withColumn("b", F.lit(1))
    return a.join(b, "k", "full").agg(F.count("a").alias("n_left"), F.count("b").alias("n_right"), F.count_if(F.col("a").isNull() | F.col("b").isNull()).alias("unmatched"))


@query("p35_clean_paths", "SELECT page_id, regexp_replace(regexp_replace(url, '[?#].*$', ''), '[0-9]+', 'N', 'g') AS path FROM pages")
def p35(spark, d):
    """URLs without query and fragment, runs of digits as N."""
    return table(spark, d, "pages").select("page_id", F.regexp_replace(F.regexp_replace("url", "[?#].*$", ""), "[0-9]+", "N").alias("path"))


@query("v04_ledger", "WITH v AS (SELECT 'lines' AS claim, count(*)::VARCHAR AS value FROM lineitem UNION ALL SELECT 'orders', count(*)::VARCHAR FROM orders UNION ALL SELECT 'documents', count(*)::VARCHAR FROM documents UNION ALL SELECT 'flag ' || l_returnflag, count(*)::VARCHAR FROM lineitem GROUP BY l_returnflag) SELECT claim, value, sha256(claim || '=' || value) AS digest FROM v")
def v04(spark, d):
    """Claims, their values as text, and a digest of both."""
    n = lambda t: table(spark, d, t).agg(F.count(F.lit(1)).cast("string").alias("value"))
    one = [n(t).select(F.lit(c).alias("claim"), "value") for c, t in (("lines", "lineitem"), ("orders", "orders"), ("documents", "documents"))]
    by = table(spark, d, "lineitem").groupBy("l_returnflag").agg(F.count(F.lit(1)).cast("string").alias("value")).select(F.concat(F.lit("flag "), "l_returnflag").alias("claim"), "value")
    return one[0].union(one[1]).union(one[2]).union(by).select("claim", "value", F.sha2(F.concat("claim", F.lit("="), "value"), 256).alias("digest"))


@query("v05_consistency", "WITH s AS (SELECT l_suppkey AS k, count(*) AS n, sum(l_quantity) AS q FROM lineitem GROUP BY 1) SELECT 'lines' AS claim, (SELECT sum(n) FROM s) = (SELECT count(*) FROM lineitem) AS holds UNION ALL SELECT 'quantity', abs((SELECT sum(q) FROM s) - (SELECT sum(l_quantity) FROM lineitem)) < 0.001 UNION ALL SELECT 'labels have documents', NOT EXISTS (SELECT 1 FROM labels l ANTI JOIN documents USING (doc_id))")
def v05(spark, d):
    """Numbers that two ways must give alike."""
    x = table(spark, d, "lineitem")
    s = x.groupBy("l_suppkey").agg(F.count(F.lit(1)).alias("n"), F.sum("l_quantity").alias("q")).agg(F.sum("n").alias("n"), F.sum("q").alias("q"))
    j = s.join(x.agg(F.count(F.lit(1)).alias("m"), F.sum("l_quantity").alias("p")))
    lost = table(spark, d, "labels").join(table(spark, d, "documents"), "doc_id", "left_anti").agg(F.count(F.lit(1)).alias("n"))
    return (
        j.select(F.lit("lines").alias("claim"), (F.col("n") == F.col("m")).alias("holds"))
        .union(j.select(F.lit("quantity"), F.abs(F.col("q") - F.col("p")) < 0.001))
        .union(lost.select(F.lit("labels have documents"), F.col("n") == 0))
    )


_CUSTOMER = "SELECT c_custkey, c_name, c_acctbal FROM customer"


def _customer(spark, d):
    return table(spark, d, "customer").select("c_custkey", "c_name", "c_acctbal")


@query("s01_delimited", _CUSTOMER)
def s01(spark, d):
    """Customers as gzipped text with tabs, read back under their schema."""
    path = scratch(spark, "s01")
    _customer(spark, d).write.csv(path, sep="\t", header=True, compression="gzip")
    return files.delimited(spark, path, "c_custkey long, c_name string, c_acctbal double", "\t")


@query("s04_latin", "SELECT c_custkey, c_name || chr(233) AS c_name FROM customer")
def s04(spark, d):
    """Customers as Latin-1 text, with a letter beyond ASCII, read back."""
    path = scratch(spark, "s04")
    _customer(spark, d).select("c_custkey", F.concat("c_name", F.lit("é")).alias("c_name")).write.csv(path, header=True, encoding="ISO-8859-1")
    return files.delimited(spark, path, "c_custkey long, c_name string", encoding="ISO-8859-1")


@query("s07_json", _CUSTOMER)
def s07(spark, d):
    """Customers as JSON lines, read back under their schema."""
    path = scratch(spark, "s07")
    _customer(spark, d).write.json(path)
    return spark.read.schema("c_custkey long, c_name string, c_acctbal double").json(path)


@query("k01_formatted", "SELECT c_custkey, round(c_acctbal / 7, 6)::DOUBLE AS part FROM customer")
def k01(spark, d):
    """A seventh of balances as the CSV sink writes them, with twelve digits, read back."""
    path = scratch(spark, "k01")
    sinks.to_csv(_customer(spark, d).select("c_custkey", (F.col("c_acctbal") / 7).cast("double").alias("part")), path, 12)
    return files.delimited(spark, path, "c_custkey long, part double").select("c_custkey", F.round("part", 6).alias("part"))


@query("v01_manifest", "SELECT 0::BIGINT AS faults, (SELECT count(*) FROM customer) AS n")
def v01(spark, d):
    """Customers as files with a manifest: what differs from it when they are read again, and their rows."""
    path = scratch(spark, "v01")
    _customer(spark, d).write.parquet(path)
    found = sinks.manifest(spark, f"{path}/*.parquet")
    faults = sinks.manifest_faults(sinks.manifest(spark, f"{path}/*.parquet"), found).agg(F.count(F.lit(1)).alias("faults"))
    return faults.join(spark.read.parquet(path).agg(F.count(F.lit(1)).alias("n")))
