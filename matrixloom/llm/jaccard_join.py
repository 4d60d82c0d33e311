"""Operator 13, n-gram Jaccard join: prefixes of rare shingles find near-equal sets, PartEnum signatures part crowds, exact counts confirm links, components label them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import distinct_shingles, lean, mixed, slices, written
from .components import connected_components

#: Words in a shingle, and the least Jaccard index of linked sets in percent.
SHINGLE, PERCENT = 3, 90
#: Parts that a part of the domain is cut into; signatures leave out one of them.
PARTS = 3
#: Bits of a set's parity sketch. Sketches never differ in more bits than sets in elements.
SKETCH = 1024
#: Comparisons of one signature up to which its sets are compared; beyond it, it is extended by signatures of another partition, LEVELS times at most.
CROWD, LEVELS = 1 << 22, 3
#: Sets, at most, whose elements are counted to put frequent ones last; elements that so few of them have count as rare, and so many of the most frequent ones are told to all tasks.
SAMPLE, RARE, FREQUENT = 1 << 14, 1, 1 << 17
#: So many times the share of a set's elements that its prefix takes are counted over all sets, to put rare ones first.
COUNTED = 2
#: Bytes of keys up to which they are broadcast to pick texts; more keys are joined by a shuffle of the texts.
BROADCAST = 64 << 20
#: Comparisons that a task holds at once.
BLOCK = 1 << 18
#: Longs, and sets, that are gathered in one block to be compared; small components of pairs share places of so many longs.
GATHERED, MEMBERS, SHARED = 1 << 18, 512, 1 << 14
_CUT = np.uint64(32)
_LOW = np.uint64(0xFFFFFFFF)


def size_bands(largest: int, percent: int = PERCENT) -> np.ndarray:
    """The largest size of each band, up to one beyond `largest`. Sets that can link are in one band or in neighbouring ones."""
    out = [0]
    while len(out) < 3 or out[-2] < largest:
        out.append(max(out[-1] + 1, (out[-1] + 1) * 10000 // percent**2))
    return np.array(out[1:])


def difference(both: int | np.ndarray | Column, percent: int = PERCENT):
    """Elements in one set but not in the other, at most, of linked sets whose sizes sum to `both`."""
    if isinstance(both, Column):
        return F.call_function("div", both * (100 - percent), F.lit(100 + percent))
    return both * (100 - percent) // (100 + percent)


def _spread(u: np.ndarray, n: np.ndarray | int) -> np.ndarray:
    """32 bits as a number below n."""
    return ((u & _LOW) * np.asarray(n, np.uint64) >> _CUT).astype(np.int64)


def signatures(whose: np.ndarray, h: np.ndarray, sizes: np.ndarray, level: int = 1, percent: int = PERCENT) -> tuple[np.ndarray, np.ndarray]:
    """(which set, signature) of sets given as elements `h` of the sets numbered `whose`.

    In a band whose linked sets differ in k elements at most, a hash deals the domain to (k + 1) / 2 parts, so linked sets differ in one element at most within
    some part; that part is dealt to three, of which two agree. So each part gives three signatures, one for each pair of its
    thirds: the sum of the hashes of their elements. A set has signatures for its own band and, if a linked set can be there, for the next.
    Where k is 0 the whole set is one signature. `level` chooses the hash that deals.
    """
    tops = size_bands(int(sizes.max(initial=1)), percent)
    own = np.searchsorted(tops, sizes)
    up = sizes * 100 // percent > tops[own]
    owners, out = [], []
    for band, some in ((own, sizes > 0), (own + 1, up & (sizes > 0))):
        parts = np.where(some, (difference(2 * tops[band], percent) + 2) // 2, 0)
        first = np.concatenate(([0], np.cumsum(parts)))
        used = some[whose]
        x, of = h[used], whose[used]
        u = mixed(x ^ mixed(band[of].astype(np.uint64), level), 2 * level + 1)
        slot = (first[of] + _spread(u >> _CUT, parts[of])) * PARTS + _spread(u, PARTS)
        sums = np.zeros(first[-1] * PARTS, np.uint64)
        np.add.at(sums, slot, mixed(x, level + 77))
        sums = sums.reshape(-1, PARTS)
        who = np.repeat(np.arange(len(sizes)), parts)
        salt = mixed((np.arange(len(who)) - first[who]).astype(np.uint64) + (band[who].astype(np.uint64) << _CUT), level)
        whole = parts[who] == 1
        whole &= difference(2 * tops[band[who]], percent) == 0
        owners.append(who[whole])
        out.append(mixed(sums[whole].sum(axis=1, dtype=np.uint64) ^ salt[whole], 3))
        for left in range(PARTS):
            a, b = sums[~whole, (left + 1) % PARTS], sums[~whole, (left + 2) % PARTS]
            owners.append(who[~whole])
            out.append(mixed(mixed(a, 5 + left) + b ^ salt[~whole], 8 + left))
    return np.concatenate(owners), np.concatenate(out)


def prefixes(whose: np.ndarray, h: np.ndarray, sizes: np.ndarray, percent: int, frequent: tuple[np.ndarray, np.ndarray], below: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """(which set, element): the elements of each set that come first in one order of all elements, so many that linked sets have one in common.

    A set has at least `percent` in a hundred of its n elements in common with a linked set, so before the first common one lie at most n * (100 - percent) / 100.
    `frequent` (elements, ascending, and their counts) puts frequent elements last, by count; the others lie by a hash. That holds in any order, but rare elements bring few sets together.
    The others whose hash is less than `below` come first in that order; of these a set gives all, also beyond its prefix.
    """
    count = np.zeros(len(h), np.int64)
    if len(frequent[0]):
        at = np.minimum(np.searchsorted(frequent[0], h), len(frequent[0]) - 1)
        count = np.where(frequent[0][at] == h, frequent[1][at], 0)
    place = mixed(h, 77)
    order = np.lexsort((place, count, whose))
    whose = whose[order]
    kept = np.arange(len(h)) - (np.cumsum(sizes) - sizes)[whose] <= (sizes * (100 - percent) // 100)[whose]
    kept |= ((count == 0) & (place < np.uint64(below)))[order]
    return whose[kept], h[order][kept]


def _sketches(whose: np.ndarray, h: np.ndarray, sets: int) -> np.ndarray:
    """A row of SKETCH / 64 longs for each set: every element flips one bit."""
    at = whose * SKETCH + (mixed(h, 99) & np.uint64(SKETCH - 1)).astype(np.int64)
    odd = np.bincount(at, minlength=sets * SKETCH).astype(np.uint8) & 1
    return np.packbits(odd.reshape(sets, SKETCH), axis=1).view(np.int64)


def _wide_sketches(whose: np.ndarray, h: np.ndarray, sizes: np.ndarray) -> pa.ListArray:
    """Parity sketches of twice as many bits as the set has elements, or up to four times, so that they tell large sets apart as well: a power of two, SKETCH at least."""
    bits = np.maximum(SKETCH, 1 << np.ceil(np.log2(2 * np.maximum(sizes, 1))).astype(np.int64))
    first = np.concatenate(([0], np.cumsum(bits)))
    at = first[whose] + (mixed(h, 98) & (bits[whose] - 1).astype(np.uint64)).astype(np.int64)
    odd = np.bincount(at, minlength=first[-1]).astype(np.uint8) & 1
    return pa.ListArray.from_arrays(pa.array((first // 64).astype(np.int32)), pa.array(np.packbits(odd).view(np.int64)))


def _lists(owner: np.ndarray, values: np.ndarray, rows: int) -> pa.ListArray:
    order = np.argsort(owner, kind="stable")
    ends = np.cumsum(np.bincount(owner, minlength=rows))
    return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], ends)).astype(np.int32)), pa.array(values[order].view(np.int64)))


def _described(docs: DataFrame, key: str, text: str, shingle: int) -> DataFrame:
    """(doc, n, h1, h2, sketch, wide) for each row: set size, 128 bits of the set and parity sketches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lo = 0
            for some in slices(b.column(1), 64):
                whose, h = distinct_shingles(some, shingle)
                sizes = np.bincount(whose, minlength=len(some))
                sums = np.zeros((2, len(some)), np.uint64)
                for k in range(2):
                    np.add.at(sums[k], whose, mixed(h, 200 + k))
                sketch = pa.ListArray.from_arrays(pa.array(np.arange(len(some) + 1, dtype=np.int32) * (SKETCH // 64)), pa.array(_sketches(whose, h, len(some)).ravel()))
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(lo, len(some)), pa.array(sizes.astype(np.int64)), *(pa.array(s.view(np.int64)) for s in sums), sketch, _wide_sketches(whose, h, sizes)],
                    ["doc", "n", "h1", "h2", "sketch", "wide"],
                )
                lo += len(some)

    rows = lean(docs).select(F.col(key).alias("doc"), F.col(text).alias("text"))
    return rows.mapInArrow(run, f"doc {rows.schema['doc'].dataType.simpleString()}, n long, h1 long, h2 long, sketch array<long>, wide array<long>")


def _stand_ins(docs: DataFrame, rows: DataFrame, classes: DataFrame, key: str, text: str) -> DataFrame:
    """(id, text) of all keyed rows but those whose key stands for no class."""
    copies = rows.select(F.col("doc").alias("id")).distinct().join(classes.select("id").distinct(), "id", "left_anti")
    keyed = lean(docs).select(F.col(key).alias("id"), F.col(text).alias("text")).where("id is not null")
    return keyed.join(F.broadcast(copies) if _bytes(copies) <= BROADCAST else copies, "id", "left_anti")


def _frequent(texts: DataFrame, sets: int, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """The FREQUENT elements, at most, that most of some SAMPLE sets have, ascending, and how many have them. They only order elements; no link depends on the sample."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for some in slices(b.column(0), 64):
                yield pa.RecordBatch.from_arrays([pa.array(distinct_shingles(some, shingle)[1].view(np.int64))], ["h"])

    some = texts.where(F.pmod(F.xxhash64("id"), F.lit(max(1, -(-sets // SAMPLE)))) == 0).select("text")
    counts = written(some.mapInArrow(run, "h long").groupBy("h").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > RARE), "jaccard-frequent")
    least, held = RARE + 1, 0
    for n, elements in sorted(counts.groupBy("n").count().collect(), reverse=True):
        held += elements
        if held > FREQUENT:
            least = n + 1
            break
    found = counts.where(F.col("n") >= least).toPandas()
    h = found["h"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(h)
    return h[order], found["n"].to_numpy(np.int64)[order]


def _signed(docs: DataFrame, rows: DataFrame, classes: DataFrame, key: str, text: str, shingle: int, percent: int) -> DataFrame:
    """(sig, id): elements of every class, made from the texts, of which linked classes share one; those that only one id has are left out.

    The elements below a bound of the hash that orders `prefixes` are counted over all classes, so that in the order that counts here they come first, rare ones before
    frequent ones. A class sends all of these, and if they are fewer than its prefix, the rest of it. What it sends beyond the length of its prefix is `spare`: so many of
    the most frequent are taken away again. A class with more elements of its own than a linked one can have is left with none.
    Texts of one id are ranked together, by which each keeps what it would by itself, or more.
    """
    texts = _stand_ins(docs, rows, classes, key, text)
    frequent = docs.sparkSession.sparkContext.broadcast(_frequent(texts, classes.count(), shingle))
    below = min((1 << 64) - 1, COUNTED * (100 - percent) * (1 << 64) // 100)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lo = 0
            for some in slices(b.column(1), 64):
                whose, h = distinct_shingles(some, shingle)
                sizes = np.bincount(whose, minlength=len(some))
                owner, sig = prefixes(whose, h, sizes, percent, frequent.value, below)
                spare = np.bincount(owner, minlength=len(some)) - 1 - sizes * (100 - percent) // 100
                yield pa.RecordBatch.from_arrays([pa.array(sig.view(np.int64)), b.column(0).take(pa.array(owner + lo)), pa.array(spare[owner].astype(np.int32))], ["sig", "id", "spare"])
                lo += len(some)

    sent = texts.mapInArrow(run, f"sig long, id {texts.schema['id'].dataType.simpleString()}, spare int")
    w = Window.partitionBy("sig")
    shared = sent.select("sig", "id", "spare", F.count(F.lit(1)).over(w).alias("sets"), F.min("id").over(w).alias("lo"), F.max("id").over(w).alias("hi")).where("lo <> hi")
    last = F.row_number().over(Window.partitionBy("id").orderBy(F.desc("sets"), F.desc("sig")))
    return shared.select("sig", "id", "spare", last.alias("last")).where("last > spare").select("sig", "id")


def _bytes(ids: DataFrame) -> int:
    """Bytes of a table of ids, and of places if it has them, as they are broadcast."""
    more = F.size("places") * 8 if "places" in ids.columns else F.lit(0)
    return ids.agg(F.sum(F.octet_length(F.col("id").cast("string")) + 24 + more)).first()[0] or 0


def _of_some(docs: DataFrame, ids: DataFrame, key: str, text: str, shingle: int, made, name: str) -> DataFrame:
    """(id, places, `name`) of the documents with some ids (id, places), whose sets are made anew from their texts: `made` gives a list for each set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lo = 0
            for some in slices(b.column(2)):
                whose, h = distinct_shingles(some, shingle)
                yield pa.RecordBatch.from_arrays([*(b.column(k).slice(lo, len(some)) for k in range(2)), made(whose, h, len(some))], ["id", "places", name])
                lo += len(some)

    texts = lean(docs).select(F.col(key).alias("id"), F.col(text).alias("text"))
    rows = texts.join(F.broadcast(ids) if _bytes(ids) <= BROADCAST else ids, "id").select("id", "places", "text")
    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, places array<long>, {name} array<long>")


def _possible(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) whose sizes and sketches allow a link."""
    each = lambda side: classes.select(F.col("id").alias(side), F.col("n").alias(f"n{side}"), F.col("sketch").alias(f"s{side}"))
    joined = pairs.join(each("a"), "a").join(each("b"), "b")
    differ = sum((F.bit_count(F.col("sa")[k].bitwiseXOR(F.col("sb")[k])) for k in range(SKETCH // 64)), F.lit(0))
    like = (F.col("na") * 100 >= F.col("nb") * percent) & (F.col("nb") * 100 >= F.col("na") * percent)
    return joined.where(like & (differ <= difference(F.col("na") + F.col("nb"), percent))).select("a", "b")


def _placed(pairs: DataFrame, sizes: DataFrame) -> DataFrame:
    """(a, b, place) for each pair: where what stands for its two ids is compared; `sizes` (id, longs) says how long that is.

    Pairs of one component of the graph of pairs meet in one place, so that a set goes there once, however many pairs it is in. The members of a component with too many longs
    or sets for one place are dealt to blocks by hash, and each two blocks that have a pair are a place. Small components share places.
    """
    found = connected_components(pairs)
    whole = found.join(sizes, F.col("node") == F.col("id")).groupBy("component").agg(F.sum("longs").alias("longs"), F.count(F.lit(1)).alias("sets"))
    whole = whole.select("component", "longs", F.greatest(F.ceil(F.col("longs") / GATHERED), F.ceil(F.col("sets") / MEMBERS)).alias("blocks"))
    bins = 1 + (whole.where("blocks = 1").agg(F.sum("longs")).first()[0] or 0) // SHARED
    of = written(found.join(whole, "component").select("node", "component", "blocks", F.pmod(F.xxhash64("node"), "blocks").alias("block")), "jaccard-blocks")
    x, y = (of.select(F.col("node").alias(s), F.col("block").alias(f"block_{s}"), *more) for s, more in (("a", ["component", "blocks"]), ("b", [])))
    two = F.xxhash64("component", F.least("block_a", "block_b"), F.greatest("block_a", "block_b"))
    place = F.when(F.col("blocks") == 1, F.pmod(F.xxhash64("component"), F.lit(bins))).otherwise(two)
    return written(pairs.join(x, "a").join(y, "b").select("a", "b", place.alias("place")), "jaccard-placed")


def _places(placed: DataFrame) -> DataFrame:
    """(id, places): all places that a pair of the id is compared at."""
    return placed.select(F.col("a").alias("id"), "place").union(placed.select("b", "place")).groupBy("id").agg(F.collect_set("place").alias("places"))


def _matched(pairs: pd.DataFrame, sets: pd.DataFrame) -> pd.DataFrame:
    """(a, b, at_a, at_b): each pair with the rows of `sets` that its ids have, by `at_a`."""
    at = pd.DataFrame({"id": sets["id"], "at": np.arange(len(sets))})
    return pairs[["a", "b"]].merge(at, left_on="a", right_on="id").merge(at, left_on="b", right_on="id", suffixes=("_a", "_b")).sort_values("at_a", kind="stable")


def sketched(pairs: pd.DataFrame, sets: pd.DataFrame, percent: int) -> pd.DataFrame:
    """The pairs (a, b) that some sketches of sets (id, n, wide) allow to link. The longer of two sketches is folded to the length of the other."""
    both = _matched(pairs, sets)
    n, wide = sets["n"].to_numpy(), sets["wide"].to_numpy()
    near = np.zeros(len(both), bool)
    for k, (x, y) in enumerate(zip(both["at_a"].to_numpy(), both["at_b"].to_numpy())):
        u, v = wide[x], wide[y]
        while len(u) != len(v):
            u, v = (v, u) if len(v) > len(u) else (u, v)
            u = u[: len(u) // 2] ^ u[len(u) // 2 :]
        near[k] = int(np.bitwise_count((u ^ v).view(np.uint64)).sum()) <= difference(int(n[x] + n[y]), percent)
    return both.loc[near, ["a", "b"]]


def linked(pairs: pd.DataFrame, sets: pd.DataFrame, percent: int) -> pd.DataFrame:
    """The pairs (a, b) of which some sets (id, elements) have the index."""
    both = _matched(pairs, sets)
    sizes = sets["elements"].map(len).to_numpy(np.int64)
    x, y = both["at_a"].to_numpy(), both["at_b"].to_numpy()
    code = np.unique(np.concatenate([np.empty(0, np.int64), *sets["elements"]]), return_inverse=True)[1]
    of = np.split(code, np.cumsum(sizes)[:-1])
    mark = np.zeros(len(code), bool)
    common = np.zeros(len(both), np.int64)
    edge = np.flatnonzero(np.diff(x, prepend=-1, append=-1)) if len(x) else []
    for lo, hi in zip(edge[:-1], edge[1:]):
        mark[of[x[lo]]] = True
        common[lo:hi] = np.add.reduceat(mark[np.concatenate([of[k] for k in y[lo:hi]])], np.cumsum(sizes[y[lo:hi]]) - sizes[y[lo:hi]], dtype=np.int64)
        mark[of[x[lo]]] = False
    return both.loc[common * 100 >= (sizes[x] + sizes[y] - common) * percent, ["a", "b"]]


def _confirmed(pairs: DataFrame, classes: DataFrame, docs: DataFrame, key: str, text: str, shingle: int, percent: int) -> DataFrame:
    """Pairs (a, b) whose sets have the index. Wide sketches rule pairs out first; sets are made anew from the texts of the documents that are left.
    Sketches and sets go to the places of their pairs, not to each pair."""
    kind = f"a {pairs.schema['a'].dataType.simpleString()}, b {pairs.schema['b'].dataType.simpleString()}"
    placed = _placed(pairs, classes.select("id", F.size("wide").alias("longs")))
    wide = classes.select("id", "n", "wide").join(_places(placed), "id").select("id", F.explode("places").alias("place"), "n", "wide")
    left = placed.groupBy("place").cogroup(wide.groupBy("place")).applyInPandas(lambda p, s: sketched(p, s, percent), kind)
    placed = _placed(written(left.distinct(), "jaccard-pairs"), classes.select("id", F.col("n").alias("longs")))
    sets = _of_some(docs, _places(placed), key, text, shingle, lambda whose, h, rows: _lists(whose, h, rows), "elements").where(F.size("elements") > 0)
    sets = sets.select("id", F.explode("places").alias("place"), "elements")
    return placed.groupBy("place").cogroup(sets.groupBy("place")).applyInPandas(lambda p, s: linked(p, s, percent), kind).distinct()


def _close_pairs(t: pa.Table, percent: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places (x, y) of a table's rows, which lie by signature: pairs of one signature, not both in its major component nor in one component, whose sizes and
    sketches allow a link. Members that are done have been compared with all others. Blocks bound what is held at once."""
    flag = lambda c: t.column(c).to_numpy(zero_copy_only=False).astype(bool)
    sketch = t.column("sketch").combine_chunks().flatten().to_numpy().view(np.uint64).reshape(len(t), -1)
    comp = t.column("comp").combine_chunks().dictionary_encode().indices.to_numpy()
    sig, n, major, done = t.column("sig").to_numpy(), t.column("n").to_numpy(), flag("major"), flag("done")
    first = np.flatnonzero(np.append(True, sig[1:] != sig[:-1]))
    size = np.diff(np.append(first, len(t)))
    begin, width = np.repeat(first, size), np.repeat(size, size)
    open_ = np.flatnonzero(~major & ~done)
    upto = np.cumsum(width[open_])
    lo = 0
    while lo < len(open_):
        hi = max(lo + 1, int(np.searchsorted(upto, (upto[lo - 1] if lo else 0) + BLOCK, "right")))
        x = open_[lo:hi]
        w = width[x]
        y = np.repeat(begin[x] - np.cumsum(w) + w, w) + np.arange(w.sum())
        x = np.repeat(x, w)
        keep = (comp[x] != comp[y]) & ~done[y] & (major[y] | (x < y)) & (n[x] * 100 >= n[y] * percent) & (n[y] * 100 >= n[x] * percent)
        x, y = x[keep], y[keep]
        for k in range(0, len(x), BLOCK // 16):
            i, j = x[k : k + BLOCK // 16], y[k : k + BLOCK // 16]
            near = np.bitwise_count(sketch[i] ^ sketch[j]).sum(1, dtype=np.int64) <= difference(n[i] + n[j], percent)
            yield i[near], j[near]
        lo = hi


def _compared(members: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """(a, b): the pairs that `_close_pairs` gives of members (sig, id, comp, major, done). Rows of a signature lie together, as many as the caller bounds them to,
    and pairs that can't link never become rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for last, b in _ending(batches):
            t = pa.Table.from_batches([b]) if held is None else pa.concat_tables([held, pa.Table.from_batches([b])])
            sig = t.column("sig").to_numpy()
            end = len(t) if last else int(np.flatnonzero(sig == sig[-1])[0])
            held, t = t.slice(end), t.slice(0, end)
            if len(t):
                ids = t.column("id").combine_chunks()
                for x, y in _close_pairs(t, percent):
                    yield pa.RecordBatch.from_arrays([ids.take(pa.array(x)), ids.take(pa.array(y))], ["x", "y"])

    of = classes.select(F.col("id").alias("of"), "n", "sketch")
    rows = members.join(of, F.col("id") == F.col("of")).select("sig", "id", "comp", "n", "sketch", (F.col("comp") == F.col("major")).alias("major"), "done")
    kind = rows.schema["id"].dataType.simpleString()
    found = lean(rows).repartition("sig").sortWithinPartitions("sig").mapInArrow(run, f"x {kind}, y {kind}")
    return found.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


def _ending(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[bool, pa.RecordBatch]]:
    """Batches with rows, and whether each is the last."""
    before = None
    for b in batches:
        if len(b):
            if before is not None:
                yield False, before
            before = b
    if before is not None:
        yield True, before


def _open_pairs(shared: DataFrame, labels: DataFrame, classes: DataFrame, docs: DataFrame, key: str, text: str, shingle: int, percent: int, crowd: int, levels: int) -> DataFrame:
    """(a, b): pairs that share a signature, lie in different components and haven't been compared, as `_compared` lets them through.

    Members outside the component of a signature's least set meet all its members. Where that is more than `crowd` comparisons, the
    signature is extended: its sets get signatures of another partition of the domain, and linked sets share one of these too. So nothing is lost, and
    unlike sets part. What is still crowded after `levels` partitions is joined, which holds no signature in one task.
    """
    comp = F.coalesce("component", "id")
    members = shared.join(labels.withColumnRenamed("node", "of"), F.col("id") == F.col("of"), "left").select("sig", "id", "lo", comp.alias("comp"), ((F.col("id") == F.col("lo")) | (F.col("id") == F.col("hi"))).alias("done"))
    out = None
    for level in range(1, levels + 1):
        major = members.where("id = lo").select(F.col("sig").alias("key"), F.col("comp").alias("major")).distinct()
        members = members.join(major, F.col("sig") == F.col("key")).drop("key")
        work = members.groupBy("sig").agg((F.count_if(F.col("comp") != F.col("major")) * F.count(F.lit(1))).alias("work")).where("work > 0")
        rest = written(members.join(work, "sig"), "jaccard-open")
        pairs = _compared(rest.where(F.col("work") <= crowd), classes, percent)
        out = pairs if out is None else out.union(pairs)
        many = rest.where(F.col("work") > crowd)
        if many.isEmpty():
            break
        if level == levels:
            x, y = many.where("comp <> major").alias("x"), many.alias("y")
            once = (F.col("y.comp") == F.col("y.major")) | (F.col("x.id") < F.col("y.id"))
            joined = x.join(y, F.col("x.sig") == F.col("y.sig")).where(F.col("x.comp") != F.col("y.comp")).where(once)
            out = out.union(_possible(joined.select(F.least("x.id", "y.id").alias("a"), F.greatest("x.id", "y.id").alias("b")).distinct(), classes, percent))
            break

        def made(whose, h, rows, level=level):
            owner, sig = signatures(whose, h, np.bincount(whose, minlength=rows), level + 1, percent)
            return _lists(owner, sig, rows)

        some = many.select("id").distinct().withColumn("places", F.array().cast("array<long>"))
        more = _of_some(docs, some, key, text, shingle, made, "more").select("id", F.explode("more").alias("more"))
        both = many.join(more, "id").select(F.xxhash64("sig", "more").alias("sig"), "id", "comp").distinct()
        ends = both.groupBy("sig").agg(F.min("id").alias("lo"), F.min("comp").alias("c0"), F.max("comp").alias("c1")).where("c0 <> c1").select("sig", "lo")
        members = both.join(ends, "sig").withColumn("done", F.lit(False))
    return out.distinct()


def similar_texts(docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = SHINGLE, percent: int = PERCENT, crowd: int = CROWD, levels: int = LEVELS) -> DataFrame:
    """(doc, n, component) of each row: its number of distinct shingles, and the smallest key that it reaches through links.

    Equal sets are one class, stood for by its least key. Classes that share one of some rare elements (`_signed`), here called a signature, are first compared with the least and the greatest of it,
    which links most copies; then all that share one and are still in different components. Sketches rule pairs out, the sets themselves decide.
    Texts without words, null ones too, link with nothing. Rows of one key are one document, which links where any of its texts does. Rows with a null
    key get the component of the keyed rows with an equal set, else null. Repeated rows stay repeated; other columns are ignored.
    """
    rows = written(_described(docs, key, text, shingle), "jaccard-rows")
    keyed = rows.where((F.col("n") > 0) & F.col("doc").isNotNull())
    classes = written(keyed.groupBy("h1", "h2").agg(F.min("doc").alias("id"), F.any_value("n").alias("n"), F.any_value("sketch").alias("sketch"), F.any_value("wide").alias("wide")), "jaccard-classes")
    each = _signed(docs, keyed, classes, key, text, shingle, percent)
    w = Window.partitionBy("sig")
    shared = written(each.select("sig", "id", F.min("id").over(w).alias("lo"), F.max("id").over(w).alias("hi")).where("lo <> hi").distinct(), "jaccard-shared")
    stars = shared.select(F.col("lo").alias("a"), F.col("id").alias("b")).union(shared.select("id", "hi")).where("a <> b").distinct()
    likely = written(_possible(stars, classes, percent), "jaccard-pairs")
    labels = connected_components(_confirmed(likely, classes, docs, key, text, shingle, percent))
    left = written(_open_pairs(shared, labels, classes, docs, key, text, shingle, percent, crowd, levels), "jaccard-pairs")
    if not left.isEmpty():
        more = _confirmed(left, classes, docs, key, text, shingle, percent)
        labels = connected_components(labels.select(F.col("node").alias("a"), F.col("component").alias("b")).union(more))
    of = labels.select(F.col("node").alias("of"), "component")
    # written, so that the join below has an exchange of its own on either side and a crowded class can be split
    named = written(classes.join(of, F.col("id") == F.col("of"), "left").select("h1", "h2", F.coalesce("component", "id").alias("component")), "jaccard-components")
    some = rows.where("n > 0").select("doc", "n", "h1", "h2").join(named, ["h1", "h2"], "left").select("doc", "n", "component")
    return some.union(rows.where("n = 0").select("doc", "n", "doc"))


def op13_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Set size and component of every document; see `similar_texts`."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return similar_texts(docs).select(F.col("doc").alias("doc_id"), F.col("n").alias("n_shingles"), F.col("component").alias("component_id"))


OP13_SQL = f"""
WITH RECURSIVE words AS (
  SELECT doc_id, list_transform(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'), lambda w: translate(w, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS w FROM documents),
sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < {SHINGLE} THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - {SHINGLE} + 2), lambda i: array_to_string(w[i : i + {SHINGLE} - 1], ' '))) END AS s FROM words),
item AS (SELECT doc_id, len(s) AS n, hash(unnest(s)) AS x FROM sets),
common AS (SELECT a.doc_id AS a, b.doc_id AS b, any_value(a.n) AS na, any_value(b.n) AS nb, count(*) AS c FROM item a JOIN item b ON a.x = b.x AND a.doc_id < b.doc_id AND a.n * 100 >= b.n * {PERCENT} AND b.n * 100 >= a.n * {PERCENT} GROUP BY 1, 2),
link AS (SELECT a, b FROM common WHERE 100 * c >= {PERCENT} * (na + nb - c)),
ways AS (SELECT a, b FROM link UNION ALL SELECT b, a FROM link),
reach AS (SELECT doc_id AS a, doc_id AS b FROM sets UNION SELECT reach.a, ways.b FROM reach JOIN ways ON reach.b = ways.a)
SELECT doc_id, len(s) AS n_shingles, (SELECT min(b) FROM reach WHERE reach.a = sets.doc_id) AS component_id FROM sets
"""
