"""Writers: formatted CSV, sorted JSON, flat reports, manifests."""

from __future__ import annotations

import gzip
import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .files import digests
from .tables import stored


def formatted(df: DataFrame, digits: int = 12) -> DataFrame:
    """Doubles as text with so many significant digits, others as they are."""
    cols = [F.format_string(f"%.{digits - 1}e", F.col(f"`{f.name}`")).cast("double").cast("string").alias(f.name) if isinstance(f.dataType, T.DoubleType) else F.col(f"`{f.name}`") for f in df.schema]
    return df.select(*cols)


def to_csv(df: DataFrame, path: str, digits: int = 12) -> None:
    """A folder of CSV parts with a header, doubles with so many digits."""
    formatted(df, digits).write.csv(path, header=True)


#: Rows of one gzip member.
MEMBER = 50_000


def csv_members(df: DataFrame, keys: list[str], rows: int = MEMBER) -> DataFrame:
    """(member, content): the rows in order of unique keys as CSV, cut after every `rows` rows, each piece gzipped by itself; the first begins with a header.

    Rows are numbered within ranges of their keys plus what lower ranges hold, so where a piece begins doesn't depend on the ranges. Pieces in order are one gzip
    file, with equal bytes for equal rows. Values are text as Spark casts them; null is empty, a text is quoted where it must be.
    """
    text = lambda c: F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(""))
    quoted = lambda x: F.when(x.rlike('[",\r\n]'), F.concat(F.lit('"'), F.replace(x, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(x)
    line = F.concat_ws(",", *[quoted(text(c)) for c in df.columns])
    ranged = stored(df.select(F.struct(*keys).alias("k"), line.alias("line")).repartitionByRange("k").withColumn("part", F.spark_partition_id()), "csv-lines")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row a range
    parts = ranged.groupBy("part").agg(F.count(F.lit(1)).alias("n")).select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    at = F.col("before") + F.row_number().over(Window.partitionBy("part").orderBy("k")) - 1
    numbered = ranged.join(parts, "part").select(F.floor(at / rows).alias("member"), at.alias("at"), "line")
    header = ",".join(f'"{c}"' if any(x in c for x in '",\n') else c for c in df.columns)

    def pack(t: pa.Table) -> pa.Table:
        member = t.column("member")[0].as_py()
        lines = t.sort_by("at").column("line").to_pylist()
        body = "\n".join([*([header] if member == 0 else []), *lines, ""]).encode()
        return pa.table({"member": [member], "content": pa.array([gzip.compress(body, mtime=0)], pa.binary())})

    return numbered.groupBy("member").applyInArrow(pack, "member long, content binary")


def to_csv_gz(df: DataFrame, path: str, keys: list[str], rows: int = MEMBER) -> None:
    """One gzipped CSV file whose bytes follow from the rows alone: tasks write the pieces of `csv_members`, and the file system joins them in order under another name first."""
    spark = df.sparkSession
    pieces = stored(csv_members(df, keys, rows), "csv-members")
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    where = jvm.org.apache.hadoop.fs.Path(path)
    fs = where.getFileSystem(conf)
    draft = jvm.org.apache.hadoop.fs.Path(path + ".draft")
    out = fs.create(draft, True)
    # pieces pass one by one; a table without rows has no piece, so the header is written alone
    empty = True
    for r in pieces.orderBy("member").toLocalIterator():
        out.write(bytes(r["content"]))
        empty = False
    if empty:
        out.write(gzip.compress((",".join(df.columns) + "\n").encode(), mtime=0))
    out.close()
    fs.delete(where, False)
    fs.rename(draft, where)


def json_lines(df: DataFrame) -> DataFrame:
    """Each row as JSON, its keys sorted, NaN and infinities as null."""
    clean = [F.when(F.isnan(f.name) | (F.abs(f.name) == float("inf")), None).otherwise(F.col(f.name)).alias(f.name) if isinstance(f.dataType, (T.DoubleType, T.FloatType)) else F.col(f.name) for f in sorted(df.schema, key=lambda f: f.name)]
    return df.select(F.to_json(F.struct(*clean), {"ignoreNullFields": "false"}).alias("value"))


def flat(df: DataFrame, sep: str = ".") -> DataFrame:
    """Fields of nested structs as columns named by their path."""

    def leaves(schema: T.StructType, base: tuple[str, ...]) -> list[tuple[str, ...]]:
        out = []
        for f in schema:
            path = (*base, f.name)
            out += leaves(f.dataType, path) if isinstance(f.dataType, T.StructType) else [path]
        return out

    def column(path: tuple[str, ...]) -> Column:
        return F.col(".".join(f"`{p}`" for p in path)).alias(sep.join(path))

    return df.select(*[column(p) for p in leaves(df.schema, ())])


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """(name, length, sha256) of a folder's files by name."""
    return digests(spark, path).select(F.element_at(F.split("path", "/"), -1).alias("name"), "length", "sha256").orderBy("name")


def manifest_faults(found: DataFrame, declared: DataFrame) -> DataFrame:
    """(name, fault): files that are missing, not declared, or changed."""
    j = declared.alias("d").join(found.alias("f"), "name", "full")
    fault = F.when(F.col("f.sha256").isNull(), "missing").when(F.col("d.sha256").isNull(), "not declared").when((F.col("d.sha256") != F.col("f.sha256")) | (F.col("d.length") != F.col("f.length")), "changed")
    return j.select("name", fault.alias("fault")).where("fault IS NOT NULL")


def digest(content: bytes) -> str:
    return hashlib.sha256(content).hexdigest()
