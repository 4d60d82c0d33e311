"""Operator 9, line dedup: repeated three-line windows leave all but their first occurrence. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import written

#: Lines in a window.
LINES = 3


def _windows(docs: DataFrame, key: str, text: str, width: int) -> DataFrame:
    """(doc, body, pos, h1, h2) for each run of `width` lines: 128 bits of hash, chained over the lines both ways. body tells texts of one key apart."""
    line = F.split(F.col(text), "\n", -1)
    hashed = F.when(F.size("line") >= width, F.transform(
        F.sequence(F.lit(0), F.size("line") - width),
        lambda i: F.struct(
            i.alias("pos"),
            F.xxhash64(*[F.get("line", i + k) for k in range(width)]).alias("h1"),
            F.xxhash64(F.lit(width), *[F.get("line", i + k) for k in reversed(range(width))]).alias("h2"),
        ),
    ))
    rows = docs.where(F.col(key).isNotNull()).select(F.col(key).alias("doc"), F.xxhash64(text).alias("body"), line.alias("line"))
    return rows.select("doc", "body", F.explode(hashed).alias("w")).select("doc", "body", "w.pos", "w.h1", "w.h2")


def repeated_windows(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = LINES) -> DataFrame:
    """(doc, body, pos) of every window that occurs earlier, by document key and then position.

    First occurrences come from an aggregation that combines on the map side. Those of repeated windows are written, so that
    both sides of the join back have an exchange of their own and adaptive execution can split hot windows.
    """
    w = _windows(docs, key, text, width)
    first = w.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("doc", "pos")).alias("at")).where("n > 1")
    first = written(first, "line-windows")
    later = w.alias("w").join(first.alias("f"), (F.col("w.h1") == F.col("f.h1")) & (F.col("w.h2") == F.col("f.h2")))
    return later.where((F.col("w.doc") != F.col("f.at.doc")) | (F.col("w.pos") != F.col("f.at.pos"))).select("w.doc", "w.body", "w.pos")


def line_dedup(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = LINES) -> DataFrame:
    """`docs` as they came, plus n_lines, n_removed and kept_text.

    Lines are what `\\n` separates, kept as they are. Every line that some later occurrence of a
    window covers goes, also where the first occurrence overlaps it; windows are judged on the input.
    A null text is empty. Rows with a null key, and texts of fewer lines than a window, stay whole.
    Rows with an equal key are one document: they don't count against each other at equal positions. Added columns replace input columns of their names.
    """
    rows = docs.select(F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("row"), F.coalesce(F.col(text), F.lit("")).alias("text"), F.col(key).alias("doc"), F.xxhash64(text).alias("own"))
    starts = repeated_windows(docs, key, text, width).groupBy(F.col("doc").alias("of"), "body").agg(F.collect_set("pos").alias("starts"))
    covered = F.array_distinct(F.flatten(F.transform("starts", lambda s: F.sequence(s, s + (width - 1)))))
    kept = F.array_except(F.sequence(F.lit(0), F.size("line") - 1), covered)
    joined = rows.join(starts, (F.col("doc") == F.col("of")) & (F.col("own") == F.col("body")), "left").select("row", "text", "starts", F.split("text", "\n", -1).alias("line"))
    out = joined.select(
        "row",
        F.size("line").cast("long").alias("n_lines"),
        F.when(F.col("starts").isNull(), F.lit(0)).otherwise(F.size(covered)).cast("long").alias("n_removed"),
        F.when(F.col("starts").isNull(), F.col("text")).otherwise(F.array_join(F.transform(kept, lambda i: F.get("line", i)), "\n")).alias("kept_text"),
    )
    own = [F.col(f"row.`{c}`").alias(c) for c in docs.columns if c not in ("n_lines", "n_removed", "kept_text")]
    return out.select(*own, "n_lines", "n_removed", "kept_text")


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its lines counted and repeated windows removed; see `line_dedup`."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return line_dedup(docs).select("doc_id", "n_lines", "n_removed", "kept_text")


OP9_SQL = """
WITH line AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
  FROM documents),
three AS (
  SELECT doc_id, pos, line, lead(line, 1) OVER w AS second, lead(line, 2) OVER w AS third, lead(pos, 2) OVER w IS NOT NULL AS whole
  FROM line WINDOW w AS (PARTITION BY doc_id ORDER BY pos)),
judged AS (
  SELECT doc_id, pos, line, whole AND row_number() OVER (PARTITION BY whole, line, second, third ORDER BY doc_id, pos) > 1 AS later FROM three),
covered AS (
  SELECT doc_id, pos, line, bool_or(later) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS gone FROM judged)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_removed,
       coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '') AS kept_text
FROM covered GROUP BY doc_id
"""
