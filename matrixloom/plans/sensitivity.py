"""Queries: how results move with panels, thresholds and relabelled endpoints."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from ..operators import geometry as G
from ..operators import ranking as R
from ..operators import ranks as W
from ..operators import resample as B
from ..operators import retrieval as T
from ..sources.tables import table
from .base import BRANDS, PRICED_SQL, priced, query, rank_sql
from .inference import _two
from .matrices import _pairs, _rounded
from .wider import _brand_pairs

#: Brands before this one make the narrow panel, all brands the wide one.
NARROW = "Brand#2"
NARROW_SIZE = sum(b < NARROW for b in BRANDS)


@query("r13_changed_pairs", f"""WITH {PRICED_SQL}, m AS (SELECT entity, avg(score) AS a, avg(score) FILTER (WHERE feature < '{NARROW}') AS l FROM priced GROUP BY 1),
c AS (SELECT entity, feature, measured, score - a AS u, score - l AS v FROM priced JOIN m USING (entity) WHERE l IS NOT NULL), f AS (SELECT feature, avg(u) AS mu, stddev_samp(u) AS su, avg(v) AS mv, stddev_samp(v) AS sv FROM c GROUP BY 1),
z AS (SELECT entity, feature, measured, (u - mu) / su AS u, (v - mv) / sv AS v FROM c JOIN f USING (feature)), p AS (SELECT a.entity, sign(round(a.u - b.u, 9)) <> sign(round(a.v - b.v, 9)) AS changed FROM z a JOIN z b ON a.entity = b.entity AND a.feature < b.feature WHERE a.measured <> b.measured),
e AS (SELECT entity, count(*) AS n, count(*) FILTER (WHERE changed) AS c FROM p GROUP BY 1) SELECT sum(n)::BIGINT AS pairs, sum(c)::BIGINT AS changed, count(*) FILTER (WHERE c > 0) AS entities FROM e""")
def r13(spark, d):
    """Pairs that are ordered otherwise if rows are centred on the narrow panel in place of all brands, before features are scaled."""
    cells = priced(spark, d)
    m = cells.groupBy("entity").agg(F.avg("score").alias("a"), F.avg(F.when(F.col("feature") < NARROW, F.col("score"))).alias("l")).where("l IS NOT NULL")
    c = cells.join(m, "entity").select("entity", "feature", "measured", (F.col("score") - F.col("a")).alias("u"), (F.col("score") - F.col("l")).alias("v"))
    f = c.groupBy("feature").agg(*[g(k).alias(f"{n}{k}") for k in "uv" for n, g in (("m", F.avg), ("s", F.stddev_samp))])
    z = c.join(f, "feature").select("entity", "feature", "measured", *[((F.col(k) - F.col(f"m{k}")) / F.col(f"s{k}")).alias(k) for k in "uv"])
    order = lambda k: F.sign(F.round(F.col(f"x_{k}") - F.col(f"y_{k}"), 9))
    p = R.entity_pairs(z, ["measured", "u", "v"]).where("x_measured <> y_measured").select("entity", (order("u") != order("v")).alias("changed"))
    e = p.groupBy("entity").agg(F.count(F.lit(1)).alias("n"), F.count_if("changed").alias("c"))
    return e.agg(F.sum("n").alias("pairs"), F.sum("c").alias("changed"), F.count_if(F.col("c") > 0).alias("entities"))


@query("r19_shifted_ranks", f"""WITH {PRICED_SQL}, f AS (SELECT feature, avg(value) AS m, stddev_samp(value) AS s FROM priced GROUP BY 1), z AS (SELECT entity, feature, round((value - m) / s, 8) AS z FROM priced JOIN f USING (feature)),
t AS (SELECT entity, feature, z, round(z - avg(z) OVER (PARTITION BY entity), 8) AS t FROM z), k AS (SELECT feature, {rank_sql('entity', 'z')} AS rz, {rank_sql('entity', 't')} AS rt FROM t) SELECT feature, round(avg(rz), 8) AS rank, count(*) FILTER (WHERE rz <> rt) AS differing FROM k GROUP BY 1""")
def r19(spark, d):
    """Mean rank of each brand within suppliers by its z score, and how many ranks differ once suppliers' means are taken off."""
    c = priced(spark, d).select("entity", "feature", "value")
    f = c.groupBy("feature").agg(F.avg("value").alias("m"), F.stddev_samp("value").alias("s"))
    z = c.join(f, "feature").select("entity", "feature", F.round((F.col("value") - F.col("m")) / F.col("s"), 8).alias("z"))
    t = z.join(z.groupBy("entity").agg(F.avg("z").alias("mean")), "entity").withColumn("t", F.round(F.col("z") - F.col("mean"), 8))
    k = t.select("feature", W.average_rank(["entity"], "z").alias("rz"), W.average_rank(["entity"], "t").alias("rt"))
    return k.groupBy("feature").agg(F.round(F.avg("rz"), 8).alias("rank"), F.count_if(F.col("rz") != F.col("rt")).alias("differing"))


@query("r20_matched_panels", f"""WITH {PRICED_SQL}, p AS (SELECT 'narrow' AS panel, {NARROW_SIZE} AS size, * FROM priced WHERE feature < '{NARROW}' UNION ALL SELECT 'wide', {len(BRANDS)}, * FROM priced), h AS (SELECT panel, entity FROM p GROUP BY 1, 2, size HAVING count(*) = size),
q AS (SELECT a.panel, a.entity, avg(CASE WHEN a.score = b.score THEN 0.5 WHEN sign(a.measured - b.measured) <> sign(a.score - b.score) THEN 1.0 ELSE 0.0 END) AS m FROM p a JOIN p b ON a.panel = b.panel AND a.entity = b.entity AND a.feature < b.feature JOIN h ON h.panel = a.panel AND h.entity = a.entity WHERE a.measured <> b.measured GROUP BY 1, 2)
SELECT panel, round(avg(m), 8) AS by_entity, count(*) AS entities FROM q GROUP BY 1""")
def r20(spark, d):
    """Concordance on two panels, each over the suppliers that have all of it; cells are read once."""
    panel = lambda name, size: F.struct(F.lit(name).alias("panel"), F.lit(size).alias("size"))
    wide, narrow = panel("wide", len(BRANDS)), panel("narrow", NARROW_SIZE)
    c = priced(spark, d).withColumn("p", F.explode(F.when(F.col("feature") < NARROW, F.array(narrow, wide)).otherwise(F.array(wide))))
    c = c.withColumn("entity", F.struct(F.col("p.panel").alias("panel"), F.col("p.size").alias("size"), F.col("entity").alias("id")))
    complete = c.groupBy("entity").agg(F.count(F.lit(1)).alias("n")).where("n = entity.size").select("entity")
    p = R.entity_pairs(c.select("entity", "feature", "measured", "score").join(complete, "entity", "left_semi"), ["measured", "score"])
    return _rounded(R.concordance(p.withColumn("panel", F.col("entity.panel")), "measured", "score", by=["panel"]).select("panel", "by_entity", "entities"), 8, "by_entity")


@query("d07_permuted_rows", """WITH o AS (SELECT quality AS y, n_chars AS x, row_number() OVER (ORDER BY sha256('44|' || doc_id), doc_id) AS k, row_number() OVER (ORDER BY sha256('45|' || doc_id), doc_id) AS h FROM documents JOIN labels USING (doc_id))
SELECT round(corr(u.y, u.x), 8) + 0.0 AS own, round(corr(u.y, v.x), 8) + 0.0 AS permuted, count(*) AS n FROM o u JOIN o v ON u.k = v.h""")
def d07(spark, d):
    """Correlation of a response with each row's own feature and with the feature of another row, dealt in hash order."""
    rows = table(spark, d, "documents").select("doc_id", F.col("n_chars").alias("x")).join(table(spark, d, "labels").select("doc_id", F.col("quality").alias("y")), "doc_id")
    one, two = B.hash_order(F.col("doc_id"), 44), B.hash_order(F.col("doc_id"), 45)
    u = W.numbered(rows.withColumn("h", one), [], "h").select("k", "y", F.col("x").alias("own"))
    v = W.numbered(rows.withColumn("h", two), [], "h").select("k", F.col("x").alias("other"))
    return u.join(v, "k").agg((F.round(F.corr("y", "own"), 8) + 0.0).alias("own"), (F.round(F.corr("y", "other"), 8) + 0.0).alias("permuted"), F.count(F.lit(1)).alias("n"))


@query("d16_diverse_sample", "SELECT s_suppkey, s_nationkey FROM (SELECT *, sha256('43|' || s_suppkey) AS h, row_number() OVER (PARTITION BY s_nationkey ORDER BY sha256('43|' || s_suppkey), s_suppkey) AS k FROM supplier) ORDER BY k > 1, h, s_suppkey LIMIT 40")
def d16(spark, d):
    """A sample of 40 suppliers: one of each nation first, then any others, in hash order."""
    s = table(spark, d, "supplier").select("s_suppkey", "s_nationkey", B.hash_order(F.col("s_suppkey"), 43).alias("h"))
    first = s.groupBy("s_nationkey").agg(F.min_by("s_suppkey", F.struct("h", "s_suppkey")).alias("first"))
    return s.join(first, "s_nationkey").orderBy(F.col("s_suppkey") != F.col("first"), "h", "s_suppkey").limit(40).select("s_suppkey", "s_nationkey")


@query("d21_degree_thresholds", f"""WITH {PRICED_SQL}, e AS (SELECT i, j, round(abs(r), 9) AS r FROM ({_pairs('priced')})), s AS (SELECT i, j, abs(r) AS s FROM ({_pairs('priced', 'score')})), m AS (SELECT round(avg(r), 6) AS m FROM e), x AS (SELECT t, i, j, (r >= t * m)::INTEGER AS hit FROM e CROSS JOIN m CROSS JOIN (VALUES (0.5), (1.0), (1.5)) v(t)),
g AS (SELECT t, f, sum(hit) AS degree FROM (SELECT t, i AS f, hit FROM x UNION ALL SELECT t, j, hit FROM x) GROUP BY 1, 2) SELECT u.t::DOUBLE AS times, round(corr(u.degree + v.degree, s.s), 7) + 0.0 AS r, round(avg(u.degree + v.degree), 8) AS degree FROM s JOIN g u ON u.f = s.i JOIN g v ON v.f = s.j AND u.t = v.t GROUP BY 1""")
def d21(spark, d):
    """How brands' degrees, counted at several multiples of the mean strength, go with the strength of pairs in another matrix."""
    c = priced(spark, d)
    e = _brand_pairs(c).select("i", "j", F.round(F.abs("r"), 9).alias("r"))
    s = _brand_pairs(c.select("entity", "feature", F.col("score").alias("value"))).select("i", "j", F.abs("r").alias("s"))
    m = e.agg(F.round(F.avg("r"), 6).alias("m"))
    x = e.join(F.broadcast(m)).withColumn("t", F.explode(F.array(*map(F.lit, (0.5, 1.0, 1.5))))).select("t", "i", "j", (F.col("r") >= F.col("t") * F.col("m")).cast("int").alias("hit"))
    g = x.select("t", F.col("i").alias("f"), "hit").union(x.select("t", "j", "hit")).groupBy("t", "f").agg(F.sum("hit").alias("degree"))
    u, v = g.select("t", F.col("f").alias("i"), F.col("degree").alias("u")), g.select("t", F.col("f").alias("j"), F.col("degree").alias("v"))
    both = F.col("u") + F.col("v")
    return s.join(u, "i").join(v, ["t", "j"]).groupBy(F.col("t").alias("times")).agg((F.round(F.corr(both, F.col("s")), 7) + 0.0).alias("r"), F.round(F.avg(both), 8).alias("degree"))


def _halves(spark, d, value):
    """The change of the correlation matrix of brands from suppliers of even to those of odd id."""
    c = priced(spark, d).select("entity", "feature", F.col(value).alias("value"), (F.col("entity") % 2).alias("part"))
    e = G.correlations(c, BRANDS, ["part"]).na.fill(0.0, ["r"])
    a, b = (G.matrix(e.where(F.col("part") == k), len(BRANDS)) for k in (0, 1))
    return b - a


@query("n03_changes_relabelled")
def n03(spark, d):
    """Rank correlation of two matrices' changes between the same halves of suppliers, under relabelling."""
    return B.tail(B.relabelled(spark, _halves(spark, d, "value"), _halves(spark, d, "score"), 100, 46), "rho")


@query("n07_semi_partialled")
def n07(spark, d):
    """t of one matrix beside another (pairs of one family) for a third: with the response moved, and with the residual predictor moved."""
    y, x = _two(spark, d)
    family = np.array([b[-1] for b in BRANDS])
    draws = B.semi_partialled(spark, y, x, (family[:, None] == family[None, :]).astype(float), 200, 47)
    each = [B.tail(draws, m).select(F.lit(m).alias("moved"), "observed", "p_upper", "p_lower", "draws") for m in ("response", "predictor")]
    return each[0].union(each[1])


@query("n24_relabelled_retrieval")
def n24(spark, d):
    """AUC of one matrix for the strongest fifth of pairs of another, under relabelling of the other."""
    a, b = _two(spark, d)
    up = np.triu_indices(len(a), 1)

    def draw(r):
        order = np.random.default_rng([48, r]).permutation(len(b)) if r else np.arange(len(b))
        return {"auc": T.pair_auc(a[up], T.strongest(b[np.ix_(order, order)][up], 0.2))}

    return B.tail(B.replicates(spark, 201, draw, ["auc"]), "auc")


@query("t08_cumulative_modes")
def t08(spark, d):
    """AUC for the strongest fifth of pairs of one matrix by the first k modes of another, for every k."""
    a, b = _two(spark, d)
    w, v = np.linalg.eigh(a)
    w, v = w[::-1], v[:, ::-1]
    up = np.triu_indices(len(a), 1)
    label = T.strongest(b[up], 0.2)
    kernel = lambda k: ((v[:, :k] * w[:k]) @ v[:, :k].T)[up]
    draws = B.replicates(spark, len(a), lambda r: {"auc": T.pair_auc(kernel(r + 1), label)}, ["auc"])
    return draws.select((F.col("replicate") + 1).cast("int").alias("modes"), "auc")
