"""Operator 2, URL filters: host-suffix and path-prefix expressions against hashed rules. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Hex digits of a digest that the equi-join compares.
SHORT = 8
#: Bytes of rules up to which they are broadcast, with what a row costs besides; more are joined by a shuffle.
BROADCAST_RULES, RULE_BYTES = 16 << 20, 200
#: verdict, host and path of the production rules.
RULES = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/")]


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a URL; both empty where it is null or has no `://`."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    host = F.regexp_extract(rest, "^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(rest)), "^[^?#]*", 0)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), path


def _digests(expression: Column) -> tuple[Column, Column]:
    digest = F.sha2(expression, 256)
    return F.substring(digest, 1, SHORT).alias("short"), digest.alias("digest")


def hashed_rules(rules: DataFrame) -> DataFrame:
    """One row for each rule expression (host || path): short, digest, host_length, rule, verdict.

    Rules with a null part are left out; of equal expressions with different verdicts, block stands.
    """
    r = rules.dropna(subset=["verdict", "host", "path"]).groupBy("host", "path").agg(F.max("verdict").alias("verdict"))
    rule = F.concat("host", "path")
    return r.select(*_digests(rule), F.length("host").alias("host_length"), rule.alias("rule"), "verdict")


def url_verdicts(urls: DataFrame, rules: DataFrame, url: str = "url") -> DataFrame:
    """(url, rule, verdict) for each distinct URL that some rule fits.

    A rule fits its host and all subdomains where the URL's path starts with the rule's path. The
    longest rule string wins; among equally long ones the longer host, then the greater string.
    Only suffixes of as many labels and prefixes of as many characters as some rule has are expanded.
    """
    known = hashed_rules(rules)
    shape = rules.dropna(subset=["verdict", "host", "path"]).agg(
        F.sum(F.octet_length("host") + F.octet_length("path") + RULE_BYTES), F.collect_set(F.size(F.split("host", "\\."))), F.collect_set(F.length("path"))
    ).first()
    if (shape[0] or 0) <= BROADCAST_RULES:
        known = F.broadcast(known)
    host, path = url_parts(F.col("url"))
    labels = F.split("host", "\\.")
    hosts = F.transform(
        F.filter(F.array(*[F.lit(k) for k in sorted(shape[1])]).cast("array<int>"), lambda k: k <= F.size(labels)),
        lambda k: F.array_join(F.slice(labels, F.size(labels) - k + 1, k), "."),
    )
    paths = F.transform(
        F.filter(F.array(*[F.lit(k) for k in sorted(shape[2])]).cast("array<int>"), lambda k: k <= F.length("path")),
        lambda k: F.col("path").substr(F.lit(1), k),
    )
    expressions = (
        urls.select(F.col(url).alias("url")).where(F.instr("url", "://") > 0).distinct()
        .select("url", host.alias("host"), path.alias("path"))
        .select("url", paths.alias("paths"), F.explode(hosts).alias("suffix"))
        .select("url", "suffix", F.explode("paths").alias("prefix"))
        .select("url", *_digests(F.concat("suffix", "prefix")))
    )
    fits = expressions.alias("e").join(known.alias("r"), F.col("e.short") == F.col("r.short")).where("e.digest = r.digest")
    best = F.max(F.struct(F.length("r.rule"), F.col("r.host_length"), F.col("r.rule").alias("rule"), F.col("r.verdict").alias("verdict")))
    return fits.groupBy("e.url").agg(best.alias("best")).select("url", "best.rule", "best.verdict")


def url_filter(pages: DataFrame, rules: DataFrame, url: str = "url", keys: tuple[str, ...] = ("page_id",), default: str = "allow") -> DataFrame:
    """Each page's key columns, host, path, rule and verdict; pages that no rule fits get `default`.

    Null and malformed URLs have empty parts and no rule. Repeated rows stay repeated; other columns
    aren't read. Equal URLs are judged once.
    """
    judged = url_verdicts(pages, rules, url).select(F.col("url").alias("_judged"), "rule", "verdict")
    host, path = url_parts(F.col("_url"))
    rows = pages.select(*keys, F.col(url).alias("_url"))
    return rows.join(judged, F.col("_url") == F.col("_judged"), "left").select(
        *keys, host.alias("host"), path.alias("path"), "rule", F.coalesce("verdict", F.lit(default)).alias("verdict")
    )


def production_rules(spark: SparkSession) -> DataFrame:
    values = ", ".join(f"('{v}', '{h}', '{p}')" for v, h, p in RULES)
    return spark.sql(f"SELECT * FROM VALUES {values} AS t(verdict, host, path)")


def op2_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Host, path, longest rule and verdict of every page's URL."""
    return url_filter(spark.read.parquet(f"{sf_dir}/pages.parquet"), production_rules(spark))


OP2_SQL = f"""
WITH rules(verdict, host, path) AS (VALUES {", ".join(f"('{v}', '{h}', '{p}')" for v, h, p in RULES)}),
rest AS (
  SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
parts AS (SELECT page_id, rest, regexp_extract(rest, '^[^/?#]*') AS raw_host FROM rest),
cut AS (
  SELECT page_id, translate(raw_host, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(substr(rest, length(raw_host) + 1), '^[^?#]*') AS path, row_number() OVER () AS k
  FROM parts),
ranked AS (
  SELECT c.page_id, c.host, c.path, r.host || r.path AS rule, r.verdict,
         row_number() OVER (PARTITION BY c.k ORDER BY length(r.host || r.path) DESC NULLS LAST, length(r.host) DESC) AS n
  FROM cut c LEFT JOIN rules r
    ON (c.host = r.host OR ends_with(c.host, '.' || r.host)) AND starts_with(c.path, r.path))
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM ranked WHERE n = 1
"""
