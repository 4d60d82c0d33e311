"""Queries: assignment, clusters, fills, and files that are written in other forms and read back."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import alignment, assignment, clusters, imputation
from ..operators import cells as C
from ..operators import resample as B
from ..sources import files, sinks
from ..sources.tables import scratch, stored, table
from .base import BRANDS, priced, query, sparse


@query("j16_assignment")
def j16(spark, d):
    """Brands of one half of the suppliers assigned to those of the other by their mean prices in each nation, in ten random halvings: how many find themselves."""
    nations = table(spark, d, "supplier").select(F.col("s_suppkey").alias("entity"), F.col("s_nationkey").alias("nation"))
    cells = priced(spark, d).join(nations, "entity").withColumn("replicate", F.explode(F.sequence(F.lit(0), F.lit(9))))
    half = (B.uniform(71, F.col("replicate"), F.col("entity")) < 0.5).cast("int")
    mean = cells.groupBy("replicate", half.alias("half"), "nation", "feature").agg(F.avg("value").alias("value"))
    side = lambda k, name: mean.where(F.col("half") == k).select("replicate", "nation", F.col("feature").alias(name), F.col("value").alias(f"{name}_value"))
    gap = F.sum(F.pow(F.col("i_value") - F.col("j_value"), 2))
    costs = side(0, "i").join(side(1, "j"), ["replicate", "nation"]).groupBy("replicate", "i", "j").agg(gap.alias("cost"))
    found = assignment.assign(costs, ["replicate"])
    return found.groupBy("replicate").agg(F.count_if(F.col("i") == F.col("j")).alias("correct"), F.count(F.lit(1)).alias("brands"), F.sum("cost").alias("total"))


@query("c03_threshold_clusters")
def c03(spark, d):
    """Suppliers in clusters by the brands that they sell in large lines: Jaccard index of at least 0.65 with the cluster's leader."""
    return clusters.threshold_clusters(sparse(spark, d).select("entity", "feature"), "entity", "feature", 65)


@query("d13_chained_fill")
def d13(spark, d):
    """Missing prices of suppliers by brands, as all the brands that a supplier sells let expect them."""
    return imputation.chained_fill(sparse(spark, d), BRANDS, ridge=10.0, within=1e-3).where("filled").select("entity", "feature", "value")


@query("d13_boosted")
def d13b(spark, d):
    """R2 of line prices in a fifth of the suppliers by boosted trees of the others."""
    x = ["l_quantity", "l_discount", "l_tax", "l_linenumber"]
    rows = table(spark, d, "lineitem").select(*[F.col(c).cast("double").alias(c) for c in x], F.col("l_extendedprice").cast("double").alias("y"), B.hash_fold(F.col("l_suppkey"), 72, 5).alias("fold"))
    out = imputation.boosted(rows.where("fold > 0"), rows.where("fold = 0"), x, "y", trees=8, depth=3)
    return out.agg((1 - F.sum(F.pow(F.col("y") - F.col("p"), 2)) / (F.var_pop("y") * F.count(F.lit(1)))).alias("r2"))


@query("p06_additive_fill")
def p06(spark, d):
    """Missing prices of suppliers by brands as supplier plus brand effect, fitted on the observed ones."""
    cells = sparse(spark, d)
    return C.additive_fill(C.grid(cells)).join(cells.select("entity", "feature"), ["entity", "feature"], "left_anti")


_CUSTOMERS = "SELECT c_custkey, c_name, c_acctbal FROM customer"


@query("k02_gzip_csv", _CUSTOMERS)
def k02(spark, d):
    """Customers as one gzipped file whose bytes follow from the rows alone, read back under their schema."""
    path = scratch(spark, "k02") + "/customers.csv.gz"  # inside the folder that is removed at the end
    sinks.to_csv_gz(table(spark, d, "customer").select("c_custkey", "c_name", "c_acctbal"), path, ["c_custkey"], 5000)
    return files.delimited(spark, path, "c_custkey long, c_name string, c_acctbal double")


@query("s09_records", _CUSTOMERS)
def s09(spark, d):
    """Customers as records of named lines, each ended by a line of its own, taken apart again."""
    path = scratch(spark, "s09")
    t = table(spark, d, "customer")
    named = [F.concat(F.lit(f"> {c}\n"), F.col(c).cast("string")) for c in ("c_custkey", "c_name", "c_acctbal")]
    t.select(F.concat(F.concat_ws("\n", *named), F.lit("\n$$$$")).alias("value")).write.text(path)
    field = lambda c: F.regexp_extract("record", f"> {c}\n([^\n]*)", 1)
    return files.text_records(spark, path).select(field("c_custkey").cast("long").alias("c_custkey"), field("c_name").alias("c_name"), field("c_acctbal").cast("double").alias("c_acctbal"))


@query("s10_fixed_width", "SELECT p_partkey, trim(p_brand) AS p_brand, p_size FROM part")
def s10(spark, d):
    """Parts as lines of fixed width, cut at their places again."""
    path = scratch(spark, "s10")
    t = table(spark, d, "part")
    t.select(F.concat(F.lit("PART  "), F.lpad(F.col("p_partkey").cast("string"), 12, " "), F.rpad("p_brand", 14, " "), F.lpad(F.col("p_size").cast("string"), 6, " ")).alias("value")).write.text(path)
    cut = files.fixed_width(spark.read.text(path).where("value LIKE 'PART%'"), {"p_partkey": (6, 18), "p_brand": (18, 32), "p_size": (32, 38)})
    kind = dict(t.dtypes)["p_size"]
    return cut.select(F.col("p_partkey").cast("long").alias("p_partkey"), "p_brand", F.col("p_size").cast(kind).alias("p_size"))


@query("s11_file_union", "SELECT l_partkey AS part, count(*) AS files, round(sum(l_extendedprice), 4) AS total FROM (SELECT l_partkey, l_linenumber, sum(l_extendedprice) AS l_extendedprice FROM lineitem GROUP BY 1, 2) GROUP BY 1")
def s11(spark, d):
    """Prices of parts in a file for each line number, united by the files' names and summed over them."""
    path = scratch(spark, "s11")
    each = table(spark, d, "lineitem").groupBy("l_partkey", "l_linenumber").agg(F.sum("l_extendedprice").alias("price"))
    each.write.partitionBy("l_linenumber").csv(path, header=True)
    read = spark.read.schema("l_partkey long, price double").csv(f"{path}/*", header=True).withColumn("file", F.regexp_extract(F.input_file_name(), "l_linenumber=([0-9]+)", 1))
    return read.groupBy(F.col("l_partkey").alias("part")).agg(F.countDistinct("file").alias("files"), F.round(F.sum("price"), 4).alias("total"))


@query("n25_exchangeability", """WITH b AS (SELECT s_nationkey AS block, count(*) AS size FROM supplier GROUP BY 1), o AS (SELECT *, list_sum([ln(k) FOR k IN range(1, size + 1)]) AS l FROM b)
SELECT block, size, size > 1 AS movable, size * (size - 1) // 2 AS pairs, round(l, 6) + 0.0 AS log_orders, round(l / sum(l) OVER (), 9) + 0.0 AS share, round(sum(l) OVER (), 6) + 0.0 AS log_all FROM o""")
def n25(spark, d):
    """What relabelling suppliers within nations can reach: each nation's size, pairs within it, orders (as logarithm) and share of all orders, and the logarithm of all of them, which bounds the least p."""
    b = table(spark, d, "supplier").groupBy(F.col("s_nationkey").alias("block")).agg(F.count(F.lit(1)).alias("size"))
    # ln n! is a running sum over sizes, so a block of any size costs one row
    most = b.agg(F.max("size").alias("most")).select(F.explode(F.sequence(F.lit(1).cast("long"), "most")).alias("k"))
    l = b.join(most, F.col("k") <= F.col("size")).groupBy("block", "size").agg(F.sum(F.log("k")).alias("l"))
    whole = l.agg(F.sum("l").alias("all"))
    out = lambda c, digits: F.round(c, digits) + 0.0
    return l.join(F.broadcast(whole)).select(
        "block", "size", (F.col("size") > 1).alias("movable"), F.expr("size * (size - 1) div 2").alias("pairs"),
        out(F.col("l"), 6).alias("log_orders"), out(F.col("l") / F.col("all"), 9).alias("share"), out(F.col("all"), 6).alias("log_all"),
    )


@query("v01_changed_files", "SELECT 'not declared' AS fault, 1::BIGINT AS files, (SELECT count(*) FROM customer) + (SELECT count(*) FROM nation) AS n")
def v01(spark, d):
    """Customers as files with a manifest of them, then one file more: what the manifest says of the folder, and its rows."""
    path = scratch(spark, "v01")
    t = table(spark, d, "customer").select(F.col("c_custkey").alias("k"))
    t.write.parquet(path)
    declared = stored(sinks.manifest(spark, f"{path}/*.parquet"), "manifest")
    table(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("k")).coalesce(1).write.mode("append").parquet(path)
    faults = sinks.manifest_faults(sinks.manifest(spark, f"{path}/*.parquet"), declared).groupBy("fault").agg(F.count(F.lit(1)).alias("files"))
    return faults.join(spark.read.parquet(path).agg(F.count(F.lit(1)).alias("n")))


@query("c06_alignment")
def c06(spark, d):
    """Identity of every part's name and type with those of the next part of its brand, by global alignment with affine gaps."""
    t = table(spark, d, "part").select("p_partkey", "p_brand", F.concat_ws(" ", "p_name", "p_type").alias("name"))
    # a brand's parts are cut at thousands of keys, so no window holds a brand
    block = F.floor(F.col("p_partkey") / 1000)
    following = Window.partitionBy("p_brand", block).orderBy("p_partkey")
    pairs = t.select("p_partkey", "name", F.lead("name").over(following).alias("next")).where("next IS NOT NULL")
    return alignment.identities(pairs, "name", "next", 5, -4, -20, -1).select("p_partkey", "score", "matches", "columns", "identity")
