"""Operator 1, quality rules: thresholds from mergeable quantile sketches per language and source, then a joined filter."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Words, lean, run_hashes, slices, whole_row, words_of, written

#: Fixed values of the base rules: symbols, words in a repeat window, fewest words, most repeated words in a hundred.
SYMBOLS, REPEAT, MIN_WORDS, MAX_REPEAT = "#*$%&|<>", 8, 20, 30
_SPACE = " \t\n\v\f\r"
#: Each measure: the count that it is a share of, what one event adds to its dividend, and whether it is fenced below too.
MEASURES = {
    "symbol_permille": ("word_chars", 1000, False), "dup_line_permille": ("n_lines", 1000, False), "repeat_permille": ("n_words", 2 * REPEAT * 1000, False),
    "echo_permille": ("n_words", 1000, False), "word_length_centi": ("n_words", 100, True),
}
#: Counts with sketches of their own: they say what one event is worth in a group's documents.
SIZES = ("word_chars", "n_lines", "n_words")
#: A fence lies this many spreads from the median. The spread is what lies between the quartiles, or what one event adds in a document of upper-quartile size if that is more.
REACH = 8
#: Documents that a language's sketch counts for in the sketch of each of its groups, and that the sketch of all counts for in every group.
PRIOR = 50
#: Parts in which sketches are blended: the weight of one document.
PARTS = 1000
#: Leading bits that a sketch keeps of a value: bucket edges are within 1/32 below the values.
PRECISION = 6
COUNTS = ["n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_echo_words"]


def _within(w: Words, width: int) -> np.ndarray:
    """Whether a run of `width` words that starts at each word ends in the same text."""
    return np.arange(len(w.h)) + width <= np.repeat(w.first[1:], np.diff(w.first))


def _per_text(w: Words, marked: np.ndarray) -> np.ndarray:
    """How many of each text's words are marked."""
    return np.diff(np.concatenate(([0], np.cumsum(marked)))[w.first])


def _repeats(w: Words, width: int = REPEAT) -> np.ndarray:
    """For each text, words covered by windows of `width` words that occur twice or more in it, the first occurrence included.

    Windows are sorted by text and 128 bits of hash, so a text costs some numbers a word.
    """
    at = np.flatnonzero(_within(w, width))
    a, b = (run_hashes(h, width)[at] for h in w.hashes)
    whose = w.text_of()[at]
    order = np.lexsort((b, a, whose))
    same = np.ones(max(len(at) - 1, 0), bool)
    for x in (a[order], b[order], whose[order]):
        same &= x[1:] == x[:-1]
    twice = np.zeros(len(at), bool)
    twice[order[1:][same]] = twice[order[:-1][same]] = True
    covered = np.zeros(len(w.h) + 1, np.int64)
    np.add.at(covered, at[twice], 1)
    np.add.at(covered, at[twice] + width, -1)
    return _per_text(w, np.cumsum(covered[:-1]) > 0)


def repeated_words(words: list[bytes], width: int = REPEAT) -> int:
    """Words of one text in windows of `width` words that occur twice or more in it."""
    return int(_repeats(words_of([b" ".join(words)], 2), width)[0])


def counts_of(texts: list[str | None]) -> np.ndarray:
    """The COUNTS of each text, a row each; all 0 for a null one. Lines count if they hold a word; an echo equals the word before it."""
    w = words_of([t.encode("utf-8", "surrogatepass") if t else b"" for t in texts], 2)
    echo = np.zeros(len(w.h), bool)
    echo[1:] = True
    for h in (*w.hashes, w.text_of()):
        echo[1:] &= h[1:] == h[:-1]
    out = np.zeros((len(texts), len(COUNTS)), np.int64)
    out[:, 0], out[:, 5], out[:, 6] = np.diff(w.first), _repeats(w), _per_text(w, echo)
    for i, t in enumerate(texts):
        if t:
            lines = [x for x in t.split("\n") if x.strip(_SPACE)]
            out[i, 1:5] = len(t) - sum(t.count(c) for c in _SPACE), sum(t.count(c) for c in SYMBOLS), len(lines), len(lines) - len(set(lines))
    return out


def text_counts(text: str | None) -> tuple[int, ...]:
    """The COUNTS of one text."""
    return tuple(counts_of([text])[0].tolist())


@F.arrow_udf(T.StructType([T.StructField(c, T.LongType()) for c in COUNTS]))
def _counts(text: pa.Array) -> pa.Array:
    rows = np.concatenate([np.empty((0, len(COUNTS)), np.int64), *map(counts_of, slices(text))])
    return pa.StructArray.from_arrays([pa.array(x) for x in rows.T], COUNTS)


#: Declared so that a filter on its result isn't pushed below it, which would count every text twice.
counted = _counts.asNondeterministic()


def measured(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """`row` (all columns of `docs`), lang, source, `c` (the counts), base_failed, and `m` (the measures, integers)."""
    c = {x: F.col(f"c.{x}") for x in COUNTS}
    share = lambda part, whole, scale: F.expr(f"c.{part} * {scale} div greatest(c.{whole}, 1)")
    measures = F.struct(
        share("n_symbols", "word_chars", 1000).alias("symbol_permille"),
        share("n_dup_lines", "n_lines", 1000).alias("dup_line_permille"),
        share("n_repeat_words", "n_words", 1000).alias("repeat_permille"),
        share("n_echo_words", "n_words", 1000).alias("echo_permille"),
        share("word_chars", "n_words", 100).alias("word_length_centi"),
    )
    rows = lean(docs).select(whole_row(docs).alias("row"), F.col(lang).alias("lang"), F.col(source).alias("source"), counted(F.col(text)).alias("c"))
    failed = (c["n_words"] < MIN_WORDS) | (c["n_repeat_words"] * 100 > c["n_words"] * MAX_REPEAT)
    return rows.select("*", failed.alias("base_failed"), measures.alias("m"))


def bucket(value: Column) -> Column:
    """The value with all but its leading bits cleared: the lower edge of its bucket in a sketch."""
    bits = F.greatest(F.length(F.bin(value)) - PRECISION, F.lit(0))
    return F.call_function("shiftleft", F.call_function("shiftright", value, bits), bits)


def sketches(rows: DataFrame) -> DataFrame:
    """(lang, source, measure, edge, n): quantile sketches of the measures and sizes of rows that pass the base rules. They merge by adding n."""
    values = {x: F.col(f"m.{x}") for x in MEASURES} | {x: F.col(f"c.{x}") for x in SIZES}
    pairs = F.array(*[F.struct(F.lit(x).alias("measure"), bucket(v).alias("edge")) for x, v in values.items()])
    each = rows.where(~F.col("base_failed")).select("lang", "source", F.explode(pairs).alias("p"))
    return each.groupBy("lang", "source", "p.measure", "p.edge").agg(F.count(F.lit(1)).alias("n"))


def _prior(sketch: DataFrame, group: list[str]) -> DataFrame:
    """(group, measure, edge, w): sketches merged to groups, each scaled to PRIOR documents."""
    merged = sketch.groupBy(*group, "measure", "edge").agg(F.sum("n").alias("n"))
    size = F.sum("n").over(Window.partitionBy(*group, "measure"))
    return merged.withColumn("size", size).select(*group, "measure", "edge", F.expr(f"n * {PRIOR * PARTS} div size").alias("w"))


def blended(sketch: DataFrame) -> DataFrame:
    """(lang, source, measure, edge, w): every group's own sketch plus those of its language and of all, as PRIOR documents each.

    So a small group has about its language's quantiles and a large one its own, with no size at which that changes.
    Sketches hold some hundred edges a measure whatever the number of documents.
    """
    groups = sketch.select("lang", "source", "measure").distinct().alias("g")
    lang, overall = _prior(sketch, ["lang"]).alias("p"), _prior(sketch, []).alias("p")
    measure = F.col("g.measure") == F.col("p.measure")
    parts = [groups.join(p, on).select("g.lang", "g.source", "g.measure", "p.edge", "p.w") for p, on in ((lang, measure & F.col("g.lang").eqNullSafe(F.col("p.lang"))), (overall, measure))]
    own = sketch.select("lang", "source", "measure", "edge", (F.col("n") * PARTS).alias("w"))
    return own.union(parts[0]).union(parts[1]).groupBy("lang", "source", "measure", "edge").agg(F.sum("w").alias("w"))


def quartiles(sketch: DataFrame) -> DataFrame:
    """(lang, source, measure, q25, q50, q75) of blended sketches; a quantile lies within its bucket as far as its rank does among the bucket's weight."""
    group = ["lang", "source", "measure"]
    w = Window.partitionBy(*group)
    ranked = blended(sketch).select("*", F.sum("w").over(w).alias("size"), F.sum("w").over(w.orderBy("edge")).alias("upto"))
    bits = F.greatest(F.length(F.bin("edge")) - PRECISION, F.lit(0))
    width = F.call_function("shiftleft", F.lit(1).cast("long"), bits)

    def at(share: int) -> Column:
        within = (F.col("size") * share / 100.0 - (F.col("upto") - F.col("w"))) / F.col("w")
        return F.min_by(F.when(F.col("upto") * 100 >= F.col("size") * share, F.col("edge") + width * within), F.when(F.col("upto") * 100 >= F.col("size") * share, F.col("edge")))

    return ranked.groupBy(*group).agg(*[at(k).alias(f"q{k}") for k in (25, 50, 75)])


def thresholds(sketch: DataFrame) -> DataFrame:
    """One row for each language and source in the sketches: low and high of each measure as columns.

    All of a fence comes from the group's blended sketches: the median, REACH times what lies between the quartiles, and where that is less, REACH times what one
    event adds to the measure in a document of the group's upper-quartile size.
    """
    q = quartiles(sketch)
    of = lambda x, c: F.max(F.when(F.col("measure") == x, F.col(c)))
    wide = q.groupBy("lang", "source").agg(*[of(x, c).alias(f"{x}_{c}") for x in (*MEASURES, *SIZES) for c in ("q25", "q50", "q75")])
    columns = []
    for x, (size, event, below) in MEASURES.items():
        reach = F.greatest(F.col(f"{x}_q75") - F.col(f"{x}_q25"), event / F.greatest(F.col(f"{size}_q75"), F.lit(1.0))) * REACH
        columns += [(F.col(f"{x}_q50") - reach if below else F.lit(0.0)).alias(f"{x}_low"), (F.col(f"{x}_q50") + reach).alias(f"{x}_high")]
    return wide.select("lang", "source", *columns)


def judged(rows: DataFrame, limits: DataFrame) -> DataFrame:
    """`rows` with `kept`: not failed by the base rules, and every measure within its group's fences.

    `limits` joins by language and source, null equal to null. Its size decides whether Spark broadcasts it.
    """
    inside = F.lit(True)
    for x in MEASURES:
        inside = inside & F.col(f"m.{x}").between(F.col(f"t.{x}_low"), F.col(f"t.{x}_high"))
    same = F.col("r.lang").eqNullSafe(F.col("t.lang")) & F.col("r.source").eqNullSafe(F.col("t.source"))
    return rows.alias("r").join(limits.alias("t"), same, "left").select("r.*", (~F.col("base_failed") & F.coalesce(inside, F.lit(True))).alias("kept"))


def quality_filter(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """The rows of `docs` that the quality rules keep, with their columns as they were.

    Null texts count as empty and fail. Null languages and sources are groups of their own. Equal rows are judged alike.
    """
    limits = written(thresholds(sketches(measured(docs, text, lang, source))), "quality-limits")
    # texts are counted again, since rows that carry them would have to be written beside their counts
    return judged(measured(docs, text, lang, source), limits).where("kept").select("row.*")


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and verdict of every document; texts are counted once, and their counts written for both uses."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang", "source")
    rows = written(measured(docs).select(F.col("row.doc_id").alias("doc_id"), "lang", "source", "c", "base_failed", "m"), "quality-rows")
    limits = written(thresholds(sketches(rows)), "quality-limits")
    return judged(rows, limits).select("doc_id", "c.n_words", "c.word_chars", "c.n_symbols", "c.n_dup_lines", "c.n_repeat_words", "base_failed", "kept")


def _sql(documents: str) -> str:
    """Common table expressions up to `verdict` (row id k, counts, base_failed, kept) over a table."""
    word = "'[^\\x20\\x09-\\x0D]+'"
    shift = lambda x: f"greatest(length(bin({x})) - {PRECISION}, 0)"
    edges = " UNION ALL ".join(f"SELECT lang, source, '{x}' AS measure, ({x} >> {shift(x)}) << {shift(x)} AS edge FROM measured WHERE NOT base_failed" for x in (*MEASURES, *SIZES))
    reach = lambda x: f"{REACH} * greatest({x}_q75 - {x}_q25, {MEASURES[x][1]} / greatest({MEASURES[x][0]}_q75, 1))"
    inside = " AND ".join(f"m.{x} BETWEEN " + (f"{x}_q50 - {reach(x)}" if MEASURES[x][2] else "0") + f" AND {x}_q50 + {reach(x)}" for x in MEASURES)
    wide = ", ".join(f"max({c}) FILTER (WHERE measure = '{x}') AS {x}_{c}" for x in (*MEASURES, *SIZES) for c in ("q25", "q50", "q75"))
    at = lambda k: f"arg_min(edge + (1 << {shift('edge')}) * ((size * {k} / 100.0 - (upto - w)) / w), edge) FILTER (WHERE upto * 100 >= size * {k}) AS q{k}"
    prior = lambda name, group: f"""{name} AS (
  SELECT {group} measure, edge, n * {PRIOR * PARTS} // sum(n) OVER (PARTITION BY {group} measure) AS w
  FROM (SELECT {group} measure, edge, count(*) AS n FROM edge GROUP BY {group} measure, edge))"""  # noqa: E731
    return f"""
doc AS (SELECT *, row_number() OVER () AS k FROM {documents}),
word AS (
  SELECT k, unnest(regexp_extract_all(coalesce(text, ''), {word})) AS word,
         generate_subscripts(regexp_extract_all(coalesce(text, ''), {word}), 1) AS pos FROM doc),
eight AS (
  SELECT k, pos, lead(pos, 7) OVER w IS NOT NULL AS whole,
         coalesce(word = lag(word) OVER w, false) AS echo,
         string_agg(word, ' ') OVER (PARTITION BY k ORDER BY pos ROWS BETWEEN CURRENT ROW AND 7 FOLLOWING) AS g
  FROM word WINDOW w AS (PARTITION BY k ORDER BY pos)),
twice AS (SELECT k, pos, echo, whole AND count(*) FILTER (WHERE whole) OVER (PARTITION BY k, g) > 1 AS twice FROM eight),
repeats AS (
  SELECT k, count(*) FILTER (WHERE hit) AS n_repeat_words, count(*) FILTER (WHERE echo) AS n_echo_words
  FROM (SELECT k, echo, bool_or(twice) OVER (PARTITION BY k ORDER BY pos ROWS BETWEEN 7 PRECEDING AND CURRENT ROW) AS hit FROM twice) GROUP BY k),
line AS (SELECT k, unnest(string_split(coalesce(text, ''), chr(10))) AS line FROM doc),
lines AS (SELECT k, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup_lines FROM line WHERE regexp_matches(line, {word}) GROUP BY k),
counted AS (
  SELECT d.*, len(regexp_extract_all(coalesce(text, ''), {word})) AS n_words,
         length(regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]+', '', 'g')) AS word_chars,
         length(coalesce(text, '')) - length(translate(coalesce(text, ''), '{SYMBOLS}', '')) AS n_symbols,
         coalesce(n_lines, 0) AS n_lines, coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words, coalesce(n_echo_words, 0) AS n_echo_words
  FROM doc d LEFT JOIN repeats USING (k) LEFT JOIN lines USING (k)),
measured AS (
  SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT} * n_words AS base_failed,
         n_symbols * 1000 // greatest(word_chars, 1) AS symbol_permille, n_dup_lines * 1000 // greatest(n_lines, 1) AS dup_line_permille,
         n_repeat_words * 1000 // greatest(n_words, 1) AS repeat_permille, n_echo_words * 1000 // greatest(n_words, 1) AS echo_permille, word_chars * 100 // greatest(n_words, 1) AS word_length_centi
  FROM counted),
edge AS ({edges}),
{prior("by_lang", "lang,")}, {prior("overall", "")},
grp AS (SELECT DISTINCT lang, source, measure FROM edge),
blend AS (
  SELECT lang, source, measure, edge, sum(w) AS w FROM (
    SELECT lang, source, measure, edge, count(*) * {PARTS} AS w FROM edge GROUP BY lang, source, measure, edge
    UNION ALL SELECT g.lang, g.source, g.measure, edge, w FROM grp g JOIN by_lang b ON g.lang IS NOT DISTINCT FROM b.lang AND g.measure = b.measure
    UNION ALL SELECT g.lang, g.source, g.measure, edge, w FROM grp g JOIN overall o ON g.measure = o.measure)
  GROUP BY lang, source, measure, edge),
quart AS (
  SELECT lang, source, measure, {at(25)}, {at(50)}, {at(75)}
  FROM (SELECT lang, source, measure, edge, w::DOUBLE AS w, sum(w) OVER (PARTITION BY lang, source, measure)::DOUBLE AS size, sum(w) OVER (PARTITION BY lang, source, measure ORDER BY edge)::DOUBLE AS upto FROM blend)
  GROUP BY lang, source, measure),
fence AS (SELECT lang AS lang_, source AS source_, true AS known, {wide} FROM quart GROUP BY lang, source),
verdict AS (
  SELECT m.*, NOT base_failed AND (t.known IS NULL OR ({inside})) AS kept
  FROM measured m LEFT JOIN fence t ON m.lang IS NOT DISTINCT FROM t.lang_ AND m.source IS NOT DISTINCT FROM t.source_)
"""


OP1_SQL = "WITH " + _sql("documents") + "SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept FROM verdict"
