"""Threshold clusters of sets: leaders by number of neighbours, from compared blocks of packed sets or, where there are many items, from a similarity join."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.tables import stored

#: Items up to which sets are compared as rows of a matrix; more are joined by their rarest items.
DENSE_ITEMS = 512
#: Sets of a block, sets of it that are compared at once, and the first free sets that a round takes in order.
BLOCK, AT_ONCE, ROUND = 8192, 1024, 4096


def equal_sets(members: DataFrame, owner: str, item: str) -> DataFrame:
    """(key, size, items, owners): distinct sets of items with their owners; `key` is the least owner, items go from the rarest on. Null items and owners are left out."""
    known = members.where(F.col(item).isNotNull() & F.col(owner).isNotNull()).select(F.col(owner).alias("owner"), F.col(item).alias("item")).distinct()
    often = known.groupBy("item").agg(F.count(F.lit(1)).alias("often"))
    ranked = known.join(often, "item").groupBy("owner").agg(F.array_sort(F.collect_list(F.struct("often", "item"))).alias("items"))
    return ranked.groupBy("items").agg(F.min("owner").alias("key"), F.count(F.lit(1)).alias("owners")).select("key", F.size("items").alias("size"), F.col("items.item").alias("items"), "owners")


def similar_sets(sets: DataFrame, percent: int) -> DataFrame:
    """(one, other): keys of distinct sets with a Jaccard index of at least `percent` in a hundred, each pair once.

    Such sets share one of their rarest items: of a set of n items those but the ceil(percent * n / 100) - 1 commonest. They are joined by these, at sizes that allow the
    index, and the items of the candidates decide.
    """
    prefix = F.col("size") - F.ceil(F.col("size") * percent / 100.0).cast("int") + 1
    each = sets.select("key", "size", F.explode(F.slice("items", 1, prefix)).alias("item"))
    a, b = each.select("item", F.col("key").alias("one"), F.col("size").alias("n")), each.select("item", F.col("key").alias("other"), F.col("size").alias("m"))
    like = (F.col("n") * 100 >= F.col("m") * percent) & (F.col("m") * 100 >= F.col("n") * percent)
    pairs = a.join(b, "item").where((F.col("one") < F.col("other")) & like).select("one", "other").distinct()
    full = lambda name: sets.select(F.col("key").alias(name), F.col("items").alias(f"{name}_items"))
    common = F.size(F.array_intersect("one_items", "other_items"))
    either = F.size("one_items") + F.size("other_items") - common
    return pairs.join(full("one"), "one").join(full("other"), "other").where(common * 100 >= either * percent).select("one", "other")


def led(sets: DataFrame, pairs: DataFrame) -> DataFrame:
    """(key, leader): clusters as a sequential pass makes them that takes sets by number of neighbours (owners of similar sets), of equals the least key first, gives each
    that isn't in a cluster one of its own, and puts its free neighbours there.

    A set leads if no free neighbour comes before it; in a round all such sets lead at once and their neighbours are no longer free, which is what the pass would
    do. Each neighbour belongs to the first of its leaders.
    """
    both = pairs.select(F.col("one").alias("key"), F.col("other").alias("near")).union(pairs.select("other", "one"))
    owners = sets.select(F.col("key").alias("near"), F.col("owners").alias("their"))
    around = both.join(owners, "near").groupBy("key").agg(F.sum("their").alias("their"))
    order = F.struct((-(F.col("owners") + F.coalesce("their", F.lit(0)))).alias("less"), F.col("key").alias("least"))
    nodes = stored(sets.select("key", "owners").join(around, "key", "left").select("key", order.alias("order")), "cluster-nodes")
    near = stored(both.join(nodes.select(F.col("key").alias("near"), F.col("order").alias("near_order")), "near"), "cluster-edges")
    free, leaders = nodes, None
    while not free.isEmpty():
        left = near.join(free.select("key"), "key").join(free.select(F.col("key").alias("near")), "near", "left_semi")
        first = left.groupBy("key").agg(F.min("near_order").alias("first"))
        now = stored(free.join(first, "key", "left").where(F.col("first").isNull() | (F.col("order") < F.col("first"))).select("key", "order"), "cluster-leaders")
        leaders = now if leaders is None else leaders.union(now)
        taken = near.join(now.select(F.col("key").alias("near")), "near", "left_semi").select("key").union(now.select("key")).distinct()
        free = stored(free.join(taken, "key", "left_anti"), "cluster-free")
    if leaders is None:
        return nodes.select("key", F.col("key").alias("leader"))
    leaders = stored(leaders, "cluster-leaders")
    of = near.join(leaders.select(F.col("key").alias("near")), "near", "left_semi").join(leaders.select("key"), "key", "left_anti")
    return of.groupBy("key").agg(F.min("near_order").alias("first")).select("key", F.col("first.least").alias("leader")).union(leaders.select("key", F.col("key").alias("leader")))


def _matrix(bits: pa.Array, items: int) -> np.ndarray:
    """Packed sets as rows of zeros and ones."""
    width = -(-items // 8)
    packed = np.frombuffer(b"".join(bits.to_pylist()), np.uint8).reshape(len(bits), width)
    return np.unpackbits(packed, axis=1, count=items).astype(np.float32)


def _like(a: np.ndarray, b: np.ndarray, percent: int) -> np.ndarray:
    """Which rows of b are similar to each row of a: 100 c >= percent (n + m - c) of c common items, as one product of small whole numbers, which 24 bits hold."""
    one = lambda x: np.ones((len(x), 1), np.float32)
    n, m = a.sum(1, keepdims=True), b.sum(1, keepdims=True)
    left = np.concatenate([a * (100 + percent), -percent * n, -percent * one(a)], 1)
    return left @ np.concatenate([b, one(b), m], 1).T >= 0


def packed_sets(sets: DataFrame, items: list) -> DataFrame:
    """(key, size, owners, bits) of the sets, their places in `items` as bits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = b.column("at")
            size = at.value_lengths().to_numpy()
            has = np.zeros((len(b), len(items)), np.uint8)
            has[np.repeat(np.arange(len(b)), size), at.flatten().to_numpy()] = 1
            bits = pa.array([r.tobytes() for r in np.packbits(has, axis=1)], pa.binary())
            yield pa.RecordBatch.from_arrays([b.column("key"), b.column("size"), b.column("owners"), bits], ["key", "size", "owners", "bits"])

    names = F.array(*map(F.lit, items)).cast(sets.schema["items"].dataType)
    place = F.transform("items", lambda x: F.array_position(names, x).cast("int") - 1)
    return sets.select("key", "size", "owners", place.alias("at")).mapInArrow(run, f"key {sets.schema['key'].dataType.simpleString()}, size int, owners long, bits binary")


def neighbours(packed: DataFrame, items: int, percent: int) -> DataFrame:
    """(key, their): owners of the sets that are similar to each set, itself included.

    Sets lie in blocks by size; every two blocks whose sizes allow the index meet in a task once, where they are multiplied. A block is one row of lists, so rows grow with
    the square of the blocks, and no pair of sets is a row.
    """
    packed.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "4m")  # few blocks in a batch
    edges = packed.groupBy("size").agg(F.count(F.lit(1)).alias("n")).orderBy("size").collect()  # a row a size, at most as many as items
    sizes = {r["size"]: -(-r["n"] // BLOCK) for r in edges}
    part = F.pmod(F.xxhash64("key"), F.element_at(F.create_map(*[F.lit(x) for kv in sizes.items() for x in kv]), F.col("size"))) if sizes else F.lit(0)
    lists = packed.withColumn("part", part).groupBy("size", "part").agg(F.collect_list(F.struct("key", "owners", "bits")).alias("rows"))
    blocks = stored(lists.select("size", "part", *[F.col(f"rows.{c}").alias(c) for c in ("key", "owners", "bits")]), "set-blocks")
    kind = packed.schema["key"].dataType.simpleString()
    side = lambda s: blocks.select(*[F.col(c).alias(f"{s}_{c}") for c in ("size", "part", "key", "owners", "bits")])
    count = sum(sizes.values())
    met = side("a").select("a_size", "a_part").join(side("b").select("b_size", "b_part"), (F.col("a_size") * 100 >= F.col("b_size") * percent) & (F.struct("a_size", "a_part") <= F.struct("b_size", "b_part")) & (F.col("b_size") * 100 >= F.col("a_size") * percent))
    pairs = met.join(side("a"), ["a_size", "a_part"]).join(side("b"), ["b_size", "b_part"]).repartition(max(1, min(2000, count * (count + 1) // 2)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(len(batch)):
                r = batch.slice(k, 1)
                own = (r.column("a_size")[0].as_py(), r.column("a_part")[0].as_py()) == (r.column("b_size")[0].as_py(), r.column("b_part")[0].as_py())
                a, b = (_matrix(r.column(f"{s}_bits").flatten(), items) for s in "ab")
                wa, wb = (r.column(f"{s}_owners").flatten().to_numpy().astype(float) for s in "ab")
                da, db = np.zeros(len(a)), np.zeros(len(b))
                for lo in range(0, len(a), AT_ONCE):
                    like = _like(a[lo : lo + AT_ONCE], b, percent).astype(np.float64)
                    da[lo : lo + AT_ONCE] = like @ wb
                    if not own:
                        db += wa[lo : lo + AT_ONCE] @ like
                yield pa.RecordBatch.from_arrays([r.column("a_key").flatten(), pa.array(da.astype(np.int64))], ["key", "their"])
                if not own:
                    yield pa.RecordBatch.from_arrays([r.column("b_key").flatten(), pa.array(db.astype(np.int64))], ["key", "their"])

    return pairs.mapInArrow(run, f"key {kind}, their long").groupBy("key").agg(F.sum("their").alias("their"))


def led_packed(packed: DataFrame, items: int, percent: int) -> DataFrame:
    """(key, leader): the clusters that `led` makes, without a table of pairs.

    A round takes the first free sets in order, some thousands, passes through them in sequence, and compares all free sets with the leaders that this finds: each goes to
    the first leader that it is similar to. Sets without neighbours lead themselves from the start, and a round's leaders are all that comes to the driver.
    """
    around = neighbours(packed, items, percent)
    nodes = stored(packed.join(around, "key").select("key", "bits", "their", (F.col("their") == F.col("owners")).alias("alone")), "cluster-nodes")
    out = [nodes.where("alone").select("key", F.col("key").alias("leader"))]
    free = nodes.where("NOT alone").select("key", "bits", "their")
    kind = packed.schema["key"].dataType.simpleString()
    while first := free.orderBy(F.desc("their"), "key").limit(ROUND).select("key", "bits").collect():
        x = _matrix(pa.array([bytes(r["bits"]) for r in first], pa.binary()), items)
        taken, heads = np.zeros(len(x), bool), []
        for k in range(len(x)):
            if not taken[k]:
                heads.append(k)
                taken |= _like(x[k : k + 1], x, percent)[0]
        leading, names = x[heads], pa.array([first[k]["key"] for k in heads])

        def run(batches: Iterator[pa.RecordBatch], leading=leading, names=names) -> Iterator[pa.RecordBatch]:
            for b in (y.slice(lo, AT_ONCE) for y in batches for lo in range(0, len(y), AT_ONCE)):
                like = _like(_matrix(b.column("bits"), items), leading, percent)
                to = pa.array(like.argmax(1), mask=~like.any(1))
                yield pa.RecordBatch.from_arrays([*b.columns, names.take(to).cast(b.column("key").type)], [*b.schema.names, "leader"])

        met = stored(free.mapInArrow(run, f"key {kind}, bits binary, their long, leader {kind}"), "cluster-round")
        out.append(met.where("leader IS NOT NULL").select("key", "leader"))
        free = met.where("leader IS NULL").drop("leader")
    whole = out[0]
    for some in out[1:]:
        whole = whole.union(some)
    return whole


def threshold_clusters(members: DataFrame, owner: str, item: str, percent: int) -> DataFrame:
    """(owner, leader): clusters of owners whose sets of items are similar to their leader's (`similar_sets`, `led`). Owners of equal sets go together; owners without items are left out.

    Few items make most sets share one, so up to DENSE_ITEMS of them sets are compared in blocks (`neighbours`, `led_packed`).
    """
    sets = stored(equal_sets(members, owner, item), "equal-sets")
    items = sorted(r[0] for r in sets.select(F.explode("items")).distinct().limit(DENSE_ITEMS + 1).collect())
    if len(items) > DENSE_ITEMS:
        clusters = led(sets, stored(similar_sets(sets, percent), "similar-sets"))
    else:
        clusters = led_packed(stored(packed_sets(sets, items), "packed-sets"), len(items), percent)
    known = members.where(F.col(item).isNotNull() & F.col(owner).isNotNull()).select(F.col(owner).alias("owner"), F.col(item).alias("item")).distinct()
    own = known.groupBy("owner").agg(F.array_sort(F.collect_list("item")).alias("all"))
    keyed = sets.select(F.array_sort("items").alias("all"), "key").join(clusters, "key").select("all", "leader")
    return own.join(keyed, "all").select(F.col("owner").alias(owner), "leader").withColumn("size", F.count(F.lit(1)).over(Window.partitionBy("leader")))
