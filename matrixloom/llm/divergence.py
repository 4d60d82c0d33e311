"""Operator 12, source divergence audit: hash-consed segment trees of term counts, walked two at a time with memoized node pairs."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import lean, mixed, words_of, written

#: Documents that a kept term is in, and ranks of the term part.
LEAST, TOP = 10, 10
#: Bytes of UTF-8 that separate terms: all of ASCII but its letters.
APART = np.array([b < 128 and not chr(b).isalpha() for b in range(256)])
#: Children of a node, and the buckets by hash in which terms of like counts are numbered.
FAN, BUCKETS = 32, 256


def counted(texts: list[str], groups: np.ndarray) -> tuple[np.ndarray, list[bytes], np.ndarray, np.ndarray]:
    """(group, term, n, docs) of texts that belong to numbered groups: occurrences and texts of every term of a group. A-Z is lower-cased.

    Words are sorted by group and 64 bits of hash; a word's other hash tells terms apart whose first ones are equal.
    """
    w = words_of([t.encode("utf-8", "surrogatepass").lower() for t in texts], 2, apart=APART)
    whose = w.text_of()
    group = groups[whose]
    key = mixed(group.astype(np.uint64), 11) ^ w.h
    order = np.argsort(key, kind="stable")
    parts = [x[order] for x in (key, w.hashes[1], group)]
    new = np.ones(len(order), bool)
    new[1:] = parts[0][1:] != parts[0][:-1]
    if any((x[1:] != x[:-1])[~new[1:]].any() for x in parts[1:]):  # equal keys of unlike words
        order = np.lexsort((w.hashes[1], w.h, group))
        for x in (w.hashes[1], w.h, group):
            new[1:] |= x[order][1:] != x[order][:-1]
    first = np.flatnonzero(new)
    text = whose[order]
    other = new.copy()
    other[1:] |= text[1:] != text[:-1]
    at = order[first]
    data, start, end = w.data, w.start[at].tolist(), w.end[at].tolist()
    sums = lambda x: np.add.reduceat(x, first, dtype=np.int64) if len(first) else np.empty(0, np.int64)
    return group[at], [data[a:b] for a, b in zip(start, end, strict=True)], sums(np.ones(len(order), np.int64)), sums(other)


def term_counts(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """(lang, source, term, n, docs): occurrences and documents of every term, counted within Arrow batches before they are shuffled. Nulls are empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            pairs = list(zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True))
            names = list(dict.fromkeys(pairs))
            number = {g: k for k, g in enumerate(names)}
            group, terms, n, seen = counted(b.column(2).to_pylist(), np.array([number[g] for g in pairs], np.int64))
            named = [pa.array([g[k] for g in names], pa.string()).take(pa.array(group)) for k in (0, 1)]
            yield pa.RecordBatch.from_arrays([*named, pa.array(terms, pa.binary()).cast(pa.string()), pa.array(n), pa.array(seen)], ["lang", "source", "term", "n", "docs"])

    blank = lambda c: F.coalesce(F.col(c), F.lit(""))
    rows = lean(docs).select(blank(lang).alias("lang"), blank(source).alias("source"), blank(text).alias("text"))
    counts = rows.mapInArrow(run, "lang string, source string, term string, n long, docs long")
    return counts.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def kept_terms(counts: DataFrame, least: int = LEAST) -> DataFrame:
    """(lang, term, total, id): terms in at least `least` documents of a language, numbered from 0 within it.

    Common terms come first, so that what a small source lacks lies together and its subtrees of zeros are one node. Numbers
    come from counts of a language's (leading bit, hash bucket) cells and ranks within a cell: no task holds a language.
    """
    cell = ["lang", "bits", "bucket"]
    kept = counts.groupBy("lang", "term").agg(F.sum("n").alias("total"), F.sum("docs").alias("docs")).where(F.col("docs") >= least)
    rows = kept.select("lang", "term", "total", F.length(F.bin("total")).alias("bits"), F.pmod(F.xxhash64("term"), F.lit(BUCKETS)).alias("bucket"))
    earlier = Window.partitionBy("lang").orderBy(F.desc("bits"), "bucket").rowsBetween(Window.unboundedPreceding, -1)
    sizes = rows.groupBy(*cell).agg(F.count(F.lit(1)).alias("size")).select(*cell, F.coalesce(F.sum("size").over(earlier), F.lit(0)).alias("before"))
    place = F.row_number().over(Window.partitionBy(*cell).orderBy("term"))
    return rows.withColumn("place", place).join(sizes, cell).select("lang", "term", "total", (F.col("before") + F.col("place") - 1).alias("id"))


def _div(a: Column, b: Column) -> Column:
    return F.call_function("div", a, b)


def share(count: Column, size: Column, terms: Column) -> Column:
    """1 + floor(10**9 * (count + 2) / (size + 2 * terms)), exact: three digits at a time, so that longs hold counts up to 10**15."""
    whole = size + 2 * terms
    rest, out = count + 2, F.lit(0)
    for _ in range(3):
        out = out * 1000 + _div(rest * 1000, whole)
        rest = rest * 1000 % whole
    return out + 1


def price(p: Column, q: Column) -> Column:
    return _div((p - q) * (p - q), p + q)


def _shares(counts: np.ndarray, whole: np.ndarray) -> np.ndarray:
    """`share` of a matrix of counts, rows of which belong to groups whose size and twice the number of terms sum to `whole`."""
    rest, out, whole = counts + 2, 0, whole[:, None]
    for _ in range(3):
        out = out * 1000 + rest * 1000 // whole
        rest = rest * 1000 % whole
    return out + 1


@F.arrow_udf(T.LongType())
def _worth(a: pa.Array, b: pa.Array, ns: pa.Array, nt: pa.Array, v: pa.Array) -> pa.Array:
    """The prices of a pair of leaf nodes (null: all counts 0) beyond those of pairs of zero counts."""
    side = lambda x: np.where(x.is_valid().to_numpy(zero_copy_only=False)[:, None], x.fill_null([0] * FAN).flatten().to_numpy().reshape(-1, FAN), 0)
    out = 0
    wholes = [n.to_numpy() + 2 * v.to_numpy() for n in (ns, nt)]
    for x, y, sign in ((side(a), side(b), 1), (np.zeros((len(a), 1), np.int64), np.zeros((len(a), 1), np.int64), -FAN)):
        p, q = _shares(x, wholes[0]), _shares(y, wholes[1])
        out = out + sign * ((p - q) * (p - q) // (p + q)).sum(axis=1)
    return pa.array(out)


def _node(children: Column) -> Column:
    """The name of a node: 128 bits of what is below it, wherever and in whichever group it stands."""
    return F.unhex(F.md5(F.array_join(children, ",", "-")))


def _level(rows: DataFrame, value: str, absent: Column | None) -> DataFrame:
    """(lang, source, pos, node, children) of the next level from (lang, source, pos, value)."""
    child = [F.max(F.when(F.col("pos") % FAN == k, F.col(value))) for k in range(FAN)]
    children = F.array(*[F.coalesce(c, absent) if absent is not None else c for c in child])
    up = rows.groupBy("lang", "source", _div(F.col("pos"), F.lit(FAN)).alias("pos")).agg(children.alias("children"))
    named = F.transform("children", lambda c: c.cast("string") if absent is not None else F.hex(c))
    return up.select("lang", "source", "pos", _node(named).alias("node"), "children")


def segment_trees(cells: DataFrame, terms: int) -> tuple[DataFrame, list[DataFrame]]:
    """Roots (lang, source, root) of each group's tree over ids below `terms`, and per level from the leaves the nodes (node, children).

    A leaf node holds FAN counts, a higher one FAN nodes; null stands for a subtree of zeros. Nodes are named by what is below them, so equal
    subtrees share one row, whatever their groups and places.
    """
    level, nodes = _level(cells.select("lang", "source", F.col("id").alias("pos"), "n"), "n", F.lit(0).cast("long")), []
    span = FAN
    while True:
        level = written(level, "segment-trees")
        nodes.append(level.select("node", "children").dropDuplicates(["node"]))
        if span >= terms:
            return level.select("lang", "source", F.col("node").alias("root")), nodes
        level = _level(level, "node", None)
        span *= FAN


def pair_sums(pairs: DataFrame, roots: DataFrame, nodes: list[DataFrame]) -> DataFrame:
    """(lang, s, t, more): for each pair of groups (lang, s, t, ns, nt, v) what its terms' prices sum to beyond all pairs of zero counts.

    Both trees are walked at once from the roots. Equal node pairs of a pair of groups become one row with a multiplicity before they are opened or priced,
    and pairs of zero subtrees are left out, so what repeats is priced once.
    """
    of = lambda side, name: roots.select("lang", F.col("source").alias(side), F.col("root").alias(name))
    front = pairs.join(of("s", "a"), ["lang", "s"], "left").join(of("t", "b"), ["lang", "t"], "left")
    front = front.where("a IS NOT NULL OR b IS NOT NULL").select("lang", "s", "t", "a", "b", F.lit(1).cast("long").alias("m"))
    other = lambda x, y: F.coalesce(F.col(x), F.concat(F.col(y), F.lit("-").cast("binary")))  # noqa: E731  an absent node meets none, and doesn't crowd the nulls' task
    for depth in reversed(range(len(nodes))):
        below = lambda name, depth=depth: nodes[depth].select(F.col("node").alias(f"at_{name}"), F.col("children").alias(f"c{name}"))
        front = front.withColumns({"ka": other("a", "b"), "kb": other("b", "a")})
        front = front.join(below("a"), F.col("ka") == F.col("at_a"), "left").join(below("b"), F.col("kb") == F.col("at_b"), "left")
        if depth:
            empty = F.array_repeat(F.lit(None).cast("binary"), FAN)
            both = F.zip_with(F.coalesce("ca", empty), F.coalesce("cb", empty), lambda x, y: F.struct(x.alias("a"), y.alias("b")))
            some = F.filter(both, lambda x: x["a"].isNotNull() | x["b"].isNotNull())
            opened = front.select("lang", "s", "t", "m", F.explode(some).alias("c")).select("lang", "s", "t", "c.a", "c.b", "m")
            front = written(opened.groupBy("lang", "s", "t", "a", "b").agg(F.sum("m").alias("m")), "node-pairs")
    worth = _worth("ca", "cb", "ns", "nt", "v")
    return front.join(pairs, ["lang", "s", "t"]).groupBy("lang", "s", "t").agg(F.sum(F.col("m") * worth).alias("more"))


def divergence(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source", least: int = LEAST, top: int = TOP) -> DataFrame:
    """(lang, source, part, item, value, rank): how far each source of a language lies from its other sources (`pair`) and from the language in its commonest excess terms (`term`).

    Null languages, sources and texts are empty ones; repeated rows are documents of their own; other columns are ignored; an empty table gives
    an empty one. A language without kept terms has pairs of value 0. Ties are ranked by item in UTF-8 order.
    """
    counts = written(term_counts(docs, text, lang, source), "term-counts")
    kept = written(kept_terms(counts, least), "kept-terms")
    langs = kept.groupBy("lang").agg(F.count(F.lit(1)).alias("v"), F.sum("total").alias("nl"))
    cells = written(counts.join(kept, ["lang", "term"]).select("lang", "source", "term", "id", "n", "total"), "kept-cells")
    blank = lambda c: F.coalesce(F.col(c), F.lit(""))
    sums = cells.groupBy("lang", "source").agg(F.sum("n").alias("ng"))
    groups = docs.select(blank(lang).alias("lang"), blank(source).alias("source")).distinct().join(sums, ["lang", "source"], "left").join(langs, "lang", "left")
    groups = written(groups.select("lang", "source", F.coalesce("ng", F.lit(0)).alias("ng"), F.coalesce("v", F.lit(0)).alias("v"), F.coalesce("nl", F.lit(0)).alias("nl")), "term-groups")

    s, t = groups.select("lang", "v", F.col("source").alias("s"), F.col("ng").alias("ns")), groups.select("lang", F.col("source").alias("t"), F.col("ng").alias("nt"))
    pairs = s.join(t, "lang").where("s < t").select("lang", "s", "t", "ns", "nt", "v")
    priced = pairs.where("v > 0")
    most = groups.agg(F.max("v")).first()[0] or 0
    if most:
        more = pair_sums(priced, *segment_trees(cells, most))
        zero = F.lit(0).cast("long")
        base = F.col("v") * price(share(zero, F.col("ns"), F.col("v")), share(zero, F.col("nt"), F.col("v")))
        valued = priced.join(more, ["lang", "s", "t"], "left").select("lang", "s", "t", (base + F.coalesce("more", zero)).alias("value"))
        valued = valued.union(pairs.where("v = 0").select("lang", "s", "t", zero))
    else:
        valued = pairs.select("lang", "s", "t", F.lit(0).cast("long").alias("value"))
    ways = F.explode(F.array(F.struct(F.col("s").alias("source"), F.col("t").alias("item")), F.struct(F.col("t").alias("source"), F.col("s").alias("item"))))
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    row = ["lang", "source", "part", "item", "value", "rank"]
    pair_part = valued.select("lang", ways.alias("w"), "value").select("lang", "w.source", F.lit("pair").alias("part"), "w.item", "value").withColumn("rank", F.row_number().over(order)).select(*row)

    p, q = share(F.col("n"), F.col("ng"), F.col("v")), share(F.col("total"), F.col("nl"), F.col("v"))
    excess = cells.join(groups, ["lang", "source"]).select("lang", "source", F.col("term").alias("item"), p.alias("p"), q.alias("q")).where("p > q")
    ranked = excess.select("lang", "source", F.lit("term").alias("part"), "item", price(F.col("p"), F.col("q")).alias("value")).withColumn("rank", F.row_number().over(order))
    return pair_part.union(ranked.where(F.col("rank") <= top).select(*row))


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The audit of all documents; see `divergence`."""
    return divergence(spark.read.parquet(f"{sf_dir}/documents.parquet").select("text", "lang", "source"))


OP12_SQL = f"""
WITH doc AS (SELECT row_number() OVER () AS k, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents),
word AS (
  SELECT k, lang, source, translate(w, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS term
  FROM (SELECT k, lang, source, unnest(regexp_extract_all(text, '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS w FROM doc)),
kept AS (SELECT lang, term, count(*) AS total FROM word GROUP BY lang, term HAVING count(DISTINCT k) >= {LEAST}),
grp AS (SELECT DISTINCT lang, source FROM doc),
cell AS (SELECT lang, source, term, count(*) AS n FROM word SEMI JOIN kept USING (lang, term) GROUP BY ALL),
counted AS (SELECT lang, source, term, coalesce(n, 0) AS n, total FROM grp JOIN kept USING (lang) LEFT JOIN cell USING (lang, source, term)),
sized AS (SELECT *, sum(n) OVER g AS ng, count(*) OVER g AS v, sum(total) OVER g AS nl FROM counted WINDOW g AS (PARTITION BY lang, source)),
p AS (SELECT lang, source, term, n, 1 + (1000000000 * (n + 2)::HUGEINT) // (ng + 2 * v) AS p, 1 + (1000000000 * (total + 2)::HUGEINT) // (nl + 2 * v) AS q FROM sized),
pair AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
both_parts AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0) AS value FROM grp a JOIN grp b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN pair x ON x.lang = a.lang AND x.source = a.source AND x.item = b.source
  UNION ALL SELECT lang, source, 'term', term, (p - q) * (p - q) // (p + q) FROM p WHERE n > 0 AND p > q)
SELECT lang, source, part, item, value::BIGINT AS value, rank::INTEGER AS rank
FROM (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM both_parts) WHERE part = 'pair' OR rank <= {TOP}
"""
