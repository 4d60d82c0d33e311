"""Operator 7, SimHash near-dedup: pigeonring candidates among distinct fingerprints, then components."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import lean, mixed, run_hashes, slices, words_of, written
from .components import connected_components

BITS = 64
#: Words in a shingle, seed of its hash, and bits in which linked fingerprints differ at most.
SHINGLE, SEED, DISTANCE = 3, 42, 2
#: Fingerprints with a common key up to which they are compared in pairs. Beyond it the key is extended, without losing a link.
PAIRWISE = 128


def fingerprint(text: str, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """Bit k is set if it is set in over half the shingle hashes; A-Z is lower-cased; 0 without words."""
    line = b" ".join(text.encode("utf-8", "surrogatepass").lower().split())
    if not line:
        return 0
    gap = np.flatnonzero(np.frombuffer(line, np.uint8) == 32)
    start = np.concatenate(([0], gap + 1))
    end = np.concatenate((gap, [len(line)]))
    n = max(1, len(start) - shingle + 1)
    last = end[-n:].tolist()
    bits = np.zeros(BITS, np.int64)
    digest = xxhash.xxh64_intdigest
    for i in range(0, n, 1 << 15):
        part = slice(i, min(n, i + (1 << 15)))
        hashes = np.array([digest(line[s:e], seed) for s, e in zip(start[part].tolist(), last[part], strict=True)], "<u8")
        bits += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * bits > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """(doc, fp): each row's fingerprint as a signed long; a null text has fingerprint 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            values = [fingerprint(t, shingle, seed) if t else 0 for some in slices(b.column(1)) for t in some]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.array(values, np.uint64).view(np.int64))], ["doc", "fp"])

    rows = lean(docs).select(F.col(key).alias("doc"), F.col(text).alias("text"))
    return rows.mapInArrow(run, f"doc {rows.schema['doc'].dataType.simpleString()}, fp long")


def _segments(distance: int) -> list[tuple[int, int]]:
    """Lowest bit and width of distance + 1 segments around the ring."""
    m = distance + 1
    cut = [BITS * i // m for i in range(m + 1)]
    return [(cut[i], cut[i + 1] - cut[i]) for i in range(m)]


def _bits(fp: Column, low: int, width: int) -> Column:
    return F.shiftrightunsigned(fp, low).bitwiseAND(F.lit((1 << width) - 1 if width < 64 else -1))


def _chains(distance: int) -> list[tuple[int, int, int, int]]:
    """Equi-join keys: lowest bit and width of a segment that agrees, and width and lowest bit of a half of the next one.

    With d + 1 segments some segment starts a chain whose first l segments differ in at most
    l * d / (d + 1) bits for every l. So the first agrees, and the second differs in one bit at
    most, which leaves one of its halves equal.
    """
    seg, out = _segments(distance), []
    for i, (low, width) in enumerate(seg):
        nlow, nwidth = seg[(i + 1) % len(seg)]
        half = nwidth // 2
        out += [(low, width, half, nlow), (low, width, nwidth - half, nlow + half)]
    return out


def _chain_holds(x: Column, slot: Column, distance: int) -> Column:
    """Whether the differing bits `x` keep within the budget along the whole chain that starts at the slot's segment."""
    seg = _segments(distance)
    m = len(seg)
    held = F.lit(False)
    for i in range(m):
        ok, total = F.lit(True), F.lit(0)
        for step in range(1, m + 1):
            total = total + F.bit_count(_bits(x, *seg[(i + step - 1) % m]))
            ok = ok & (total <= step * distance // m)
        held = held | (F.floor(slot / 2).eqNullSafe(F.lit(i)) & ok)
    return held


def _signed(mask: int) -> Column:
    return F.lit(mask - (1 << BITS) if mask >> BITS - 1 else mask).cast("long")


def _parts(level: int, parts: int) -> list[int]:
    """All bits dealt to parts, differently at each level: masks."""
    order = np.random.default_rng(level).permutation(BITS).tolist()
    return [sum(1 << k for k in order[i::parts]) for i in range(parts)]


def links(distinct: DataFrame, distance: int = DISTANCE, pairwise: int = PAIRWISE) -> DataFrame:
    """(a, b): links between distinct fingerprints (column fp) that connect all those within `distance` bits.

    Keys that one fingerprint alone has are dropped first. Fingerprints that share a key with at most
    `pairwise` others are compared in pairs: chain budgets, then the whole Hamming distance. More crowded keys
    go on to further segments: all bits are dealt to distance + 1 parts, of which at least one agrees, and each part
    is joined to the key in turn; a level deals the bits anew. What a key leaves open shrinks at each level, and a key that leaves
    `distance` bits open has 2 ** distance fingerprints at most, so no bucket makes pairs in its square and no link is lost.
    """
    if distance < 0:
        raise ValueError("distance is 0 or more")
    if distance == 0:
        return distinct.select(F.col("fp").alias("a"), F.col("fp").alias("b")).where("a <> b")
    most = max(pairwise, 1 << distance)
    known = []
    for low, width, half, at in _chains(distance):
        known += [((1 << width) - 1) << low | ((1 << half) - 1) << at]
    key = ["slot", "known", "bits"]
    made = F.array(*[F.struct(F.lit(i).alias("slot"), _signed(m).alias("known")) for i, m in enumerate(known)])
    keyed = distinct.select("fp", F.explode(made).alias("k")).select("fp", "k.slot", "k.known", F.col("fp").bitwiseAND(F.col("k.known")).alias("bits"))
    x = F.col("l.fp").bitwiseXOR(F.col("r.fp"))
    out = None
    for level in range(1, 1 << 10):
        shared = keyed.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
        members = written(keyed.join(shared, key), "simhash-buckets")
        few = members.where(F.col("n") <= most)
        pairs = (
            few.alias("l").join(few.alias("r"), key).where("l.fp < r.fp")
            .where(_chain_holds(x, F.col("slot"), distance)).where(F.bit_count(x) <= distance)
            .select(F.col("l.fp").alias("a"), F.col("r.fp").alias("b"))
        )
        out = pairs if out is None else out.union(pairs)
        crowded = members.where(F.col("n") > most)
        if crowded.isEmpty():
            break
        more = F.explode(F.array(*[_signed(m) for m in _parts(level, distance + 1)]))
        wider = crowded.select("fp", "slot", "known", more.alias("more")).select("fp", "slot", F.col("known").bitwiseOR(F.col("more")).alias("known"))
        keyed = wider.distinct().select("*", F.col("fp").bitwiseAND(F.col("known")).alias("bits"))
    else:
        raise ValueError("keys are still crowded")
    return out.distinct()


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = SHINGLE, seed: int = SEED, distance: int = DISTANCE, pairwise: int = PAIRWISE) -> DataFrame:
    """(doc, fp, component): each row's fingerprint and the smallest key that it reaches through links.

    Rows of equal fingerprints form one node. Rows with a null key get the component of their group
    (null if it has no other keys); repeated rows stay repeated; empty and null texts have fingerprint 0.
    """
    rows = written(fingerprints(docs, key, text, shingle, seed), "fingerprints")
    nodes = rows.groupBy("fp").agg(F.min("doc").alias("least"))
    found = connected_components(links(nodes.select("fp"), distance, pairwise))
    linked = written(found.join(nodes, found["node"] == nodes["fp"]).select("node", "component", "least"), "simhash-linked")
    best = linked.groupBy("component").agg(F.min("least").alias("reached"))
    own = linked.join(best, "component").select("node", "reached")
    # written, so that the join below has an exchange of its own on either side and a crowded fingerprint can be split
    labelled = written(nodes.join(own, nodes["fp"] == own["node"], "left").select(F.col("fp").alias("of"), F.coalesce("reached", "least").alias("component")), "simhash-labels")
    return rows.join(labelled, rows["fp"] == labelled["of"]).select("doc", "fp", "component")


#: Fingerprints for copies that are merely alike: bits, words in a shingle, and bits in which they differ at most: a Jaccard index of 0.8 leaves 312 on average, with a spread of 16.
WIDE, WIDE_SHINGLE, WIDE_DISTANCE = 2048, 5, 332
#: Bits of a segment (chains from one segment and the next share few bits, so that each is a try of its own), and bits by which a chain is wider than the logarithm of the number of fingerprints: strangers seldom share one.
SEGMENT, SPARE = 16, 4
#: A byte's bits, each in a byte of its own.
_SPREAD = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).view("<u8")[:, 0]


def wide_fingerprints(texts: list[str | None], shingle: int = WIDE_SHINGLE) -> np.ndarray:
    """A row of WIDE / 8 bytes for each text: a bit is set if it is set in over half the hashes of its shingles.

    A-Z is lower-cased; a text of fewer words is one shingle, one without words has no bit set. Repeated shingles count once.
    """
    w = words_of([t.encode("utf-8", "surrogatepass").lower() if t else b"" for t in texts])
    n = np.diff(w.first)
    runs = run_hashes(w.h, shingle)
    whose = w.text_of()[: len(runs)]
    inside = np.arange(len(runs)) + shingle <= w.first[1:][whose]
    short = np.flatnonzero((n > 0) & (n < shingle))
    h = np.concatenate([runs[inside], *[run_hashes(w.h[w.first[k] : w.first[k + 1]], int(n[k])) for k in short.tolist()]])
    whose = np.concatenate([whose[inside], short])
    order = np.lexsort((h, whose))
    h, whose = h[order], whose[order]
    new = (np.diff(h, prepend=~h[:1]) != 0) | (np.diff(whose, prepend=-1) != 0)
    h, whose = h[new], whose[new]
    out = np.zeros((len(texts), WIDE // 8), np.uint8)
    if len(h):
        heads = np.flatnonzero(np.diff(whose, prepend=-1))
        size = np.diff(np.append(heads, len(h)))
        blocks = np.concatenate([np.arange(a, a + k, 255) for a, k in zip(heads.tolist(), size.tolist())])  # a byte counts to 255
        of = np.searchsorted(blocks, heads)
        ends = np.append(blocks[1:], len(h))
        for lane in range(WIDE // 64):
            summed = np.empty((len(blocks), 8), np.uint64)
            for p in range(0, len(blocks), 512):  # some megabytes at once, also for a very long text
                some = slice(p, min(p + 512, len(blocks)))
                lo, hi = blocks[p], ends[some.stop - 1]
                summed[some] = np.add.reduceat(_SPREAD[mixed(h[lo:hi], lane + 1).view(np.uint8)].reshape(-1, 8), blocks[some] - lo, axis=0)
            counts = np.add.reduceat(summed.view(np.uint8).reshape(len(blocks), 64), of, axis=0, dtype=np.int64)
            out[whose[heads], 8 * lane : 8 * lane + 8] = np.packbits(2 * counts > size[:, None], axis=1)
    return out


def chains(fps: np.ndarray, width: int) -> np.ndarray:
    """The `width` bits (62 at most) from each segment of the ring on, as integers: a row for each row of bytes, a column for each segment."""
    bits = np.unpackbits(fps, axis=1)
    ring = np.concatenate([bits, bits[:, :width]], 1)
    out = np.zeros((len(fps), WIDE // SEGMENT), np.int64)
    for k in range(width):
        out = out << 1 | ring[:, k : k + WIDE : SEGMENT]
    return out


def chain_width(n: int) -> int:
    """Bits of a chain among n fingerprints."""
    return min(60, math.ceil(math.log2(max(n, 2))) + SPARE)


def chain_links(nodes: DataFrame, width: int, distance: int = WIDE_DISTANCE) -> DataFrame:
    """(a, b): links between nodes (id; fp, WIDE / 64 longs) whose fingerprints differ in at most `distance` bits.

    Of the chains of segments that stay within their budgets those that agree in `width` bits are looked up, from every segment of the ring on,
    so not all links are found: the more alike, the likelier. Each node of a chain is compared with the least one of it, and two that
    aren't the least meet through it or in another chain. So candidates are at most as many as segments for each node,
    however large a group. Candidates are ids; fingerprints join them once each for the Hamming distance.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (x.slice(lo, 1000) for x in batches for lo in range(0, len(x), 1000)):
            words = b.column(1).flatten().to_numpy().reshape(len(b), WIDE // 64)
            runs = chains(np.ascontiguousarray(words).view(np.uint8), width)
            start = np.tile(np.arange(runs.shape[1], dtype=np.int32), len(b))
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(b.column(0).to_numpy(), runs.shape[1])), pa.array(start), pa.array(runs.ravel())], ["id", "start", "run"])

    key = ["start", "run"]
    keyed = nodes.select("id", "fp").mapInArrow(run, "id long, start int, run long")
    shared = written(keyed.groupBy(*key).agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("a")).where("n > 1").drop("n"), "simhash-chains")
    found = keyed.join(shared, key).where("id <> a").select("a", F.col("id").alias("b")).distinct()
    each = lambda side: nodes.select(F.col("id").alias(side), F.col("fp").alias(f"fp_{side}"))
    differ = sum((F.bit_count(F.col("fp_a")[k].bitwiseXOR(F.col("fp_b")[k])) for k in range(WIDE // 64)), F.lit(0))
    return found.join(each("a"), "a").join(each("b"), "b").where(differ <= distance).select("a", "b")


def alike(docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = WIDE_SHINGLE, distance: int = WIDE_DISTANCE) -> DataFrame:
    """(doc, component): each row's key and the smallest key that it reaches through links of wide fingerprints.

    Links join texts whose five-word shingles have a Jaccard index of about 0.8 or more; how many of them are found is
    measured, not proven. Rows of equal fingerprints are one node. Rows with a null key get the component of
    their group (null if it has no other keys); repeated rows stay repeated.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.concatenate([np.empty((0, WIDE // 8), np.uint8), *(wide_fingerprints(some, shingle) for some in slices(b.column(1)))])
            longs = pa.array(fps.view(np.int64).ravel())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(pa.array(np.arange(len(fps) + 1, dtype=np.int32) * (WIDE // 64)), longs)], ["doc", "fp"])

    texts = lean(docs).select(F.col(key).alias("doc"), F.col(text).alias("text"))
    rows = written(texts.mapInArrow(run, f"doc {texts.schema['doc'].dataType.simpleString()}, fp array<long>"), "fingerprints")
    hashed = F.xxhash64("fp").alias("id")
    nodes = written(rows.groupBy("fp").agg(F.min("doc").alias("least")).select(hashed, "fp", "least"), "simhash-nodes")
    found = connected_components(chain_links(nodes.select("id", "fp"), chain_width(nodes.count()), distance))
    linked = written(found.join(nodes, found["node"] == nodes["id"]).select("node", "component", "least"), "simhash-linked")
    best = linked.groupBy("component").agg(F.min("least").alias("reached"))
    own = linked.join(best, "component").select("node", "reached")
    # written, so that the join below has an exchange of its own on either side and a crowded fingerprint can be split
    labelled = written(nodes.join(own, nodes["id"] == own["node"], "left").select(F.col("id").alias("of"), F.col("fp").alias("own"), F.coalesce("reached", "least").alias("component")), "simhash-labels")
    return rows.join(labelled, (hashed == labelled["of"]) & (rows["fp"] == labelled["own"])).select("doc", "component")


def op7_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document; see `near_duplicates`."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return near_duplicates(docs).select(F.col("doc").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("component").alias("component_id"))
