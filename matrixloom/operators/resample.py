"""Permutation nulls, bootstraps, jackknives, splits and supports. Every replicate draws from its own seed."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .geometry import pair_moments, rows_of
from .moments import STATE, batch_state, correlation, joined, merged
from .ranks import carried, numbered, ranged
from .retrieval import pair_auc, strongest

#: Rows of independently dealt columns that are shuffled together, and rows that trade together.
BLOCK = 1024


def replicates(spark: SparkSession, count: int, draw: Callable[[int], dict[str, float]], columns: list[str]) -> DataFrame:
    """(replicate, columns): `draw(r)` for r below count, spread over tasks; results don't depend on how they are dealt.

    What `draw` closes over goes to every task, so it holds matrices of features or bounded samples only.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame([{"replicate": int(r)} | draw(int(r)) for r in b["id"]], columns=["replicate", *columns])

    parts = min(count, max(1, spark.sparkContext.defaultParallelism))
    return spark.range(0, count, 1, parts).mapInPandas(run, "replicate long, " + ", ".join(f"{c} double" for c in columns))


def uniform(*key: Column | str | int) -> Column:
    """A number in (0, 1) that a key determines: the first 52 bits of SHA-256 of its parts, joined by bars."""
    parts = [(k if isinstance(k, Column) else F.lit(k)).cast("string") for k in key]
    return (F.conv(F.substring(F.sha2(F.concat_ws("|", *parts), 256), 1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52)


def ranked(x: np.ndarray) -> np.ndarray:
    """Average ranks along the last axis."""
    flat = np.atleast_2d(x)
    out = np.array([pd.Series(row).rank().to_numpy() for row in flat])
    return out.reshape(np.shape(x))


def _upper(m: np.ndarray) -> np.ndarray:
    return m[np.triu_indices(len(m), 1)]


def _unit(x: np.ndarray) -> np.ndarray:
    x = x - x.mean()
    return x / np.linalg.norm(x)


def relabelled(spark: SparkSession, a: np.ndarray, b: np.ndarray, count: int, seed: int, blocks: list[int] | None = None, control: np.ndarray | None = None) -> DataFrame:
    """(replicate, rho): rank correlation of two pair matrices after features of `b` are relabelled; replicate 0 isn't.

    Labels move within `blocks` if given. With `control` both ranks are first cleared of the control's ranks.
    """
    p = len(a)
    block = np.zeros(p, int) if blocks is None else np.asarray(blocks)
    clear = None if control is None else _unit(ranked(_upper(control)))

    def rest(x: np.ndarray) -> np.ndarray:
        u = _unit(ranked(x))
        return u if clear is None else _unit(u - (u @ clear) * clear)

    fixed = rest(_upper(a))

    def draw(r: int) -> dict[str, float]:
        order = np.arange(p)
        if r:
            rng = np.random.default_rng([seed, r])
            for k in np.unique(block):
                at = np.flatnonzero(block == k)
                order[at] = rng.permutation(at)
        return {"rho": float(fixed @ rest(_upper(b[np.ix_(order, order)])))}

    return replicates(spark, count + 1, draw, ["rho"])


def unranked(number: np.ndarray, blocks: list[int]) -> np.ndarray:
    """The relabellings with these numbers, a row each: a number's digits, one for each place of a block, pick the block's labels in turn.

    Number 0 moves nothing; numbers below `orders_within(blocks)` give every relabelling within blocks once.
    """
    out = np.tile(np.arange(len(blocks)), (len(number), 1))
    rest = np.asarray(number, np.int64).copy()
    for block in dict.fromkeys(blocks):
        at = np.flatnonzero(np.asarray(blocks) == block)
        left = np.tile(at, (len(rest), 1))
        for k in range(len(at)):
            digit, rest = rest % (len(at) - k), rest // (len(at) - k)
            out[:, at[k]] = left[np.arange(len(rest)), digit]
            keep = np.arange(left.shape[1])[None] != digit[:, None]
            left = left[keep].reshape(len(rest), -1)
    return out


def orders_within(blocks: list[int]) -> int:
    """Distinct relabellings within blocks."""
    return orders_of([blocks.count(b) for b in dict.fromkeys(blocks)])


def enumerated(spark: SparkSession, a: np.ndarray, b: np.ndarray, blocks: list[int] | None = None, most: int = 100_000) -> DataFrame:
    """(order, rho): rank correlation of two pair matrices under every relabelling of `b` within blocks (all features are one without them); order 0 is the true one.

    Orders are numbers that Spark deals to tasks in ranges; a task makes the relabellings of its own numbers. Raises if there are more than `most`.
    """
    blocks = [0] * len(a) if blocks is None else list(blocks)
    total = orders_within(blocks)
    if total > most:
        raise ValueError(f"{total} orders, at most {most} are enumerated")
    upper = np.triu_indices(len(a), 1)
    fixed = _unit(ranked(_upper(a)))
    other = np.zeros(b.shape)
    other[upper] = _unit(ranked(_upper(b)))  # relabelling moves ranks but doesn't change them
    other += other.T

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for some in (x.iloc[lo : lo + 2000] for x in batches for lo in range(0, len(x), 2000)):
            o = unranked(some["id"].to_numpy(), blocks)
            yield pd.DataFrame({"order": some["id"], "rho": other[o[:, upper[0]], o[:, upper[1]]] @ fixed})

    return spark.range(0, total, 1, 4 * spark.sparkContext.defaultParallelism).mapInPandas(run, "order long, rho double")


def exact_tail(orders: DataFrame) -> DataFrame:
    """(observed, p, orders): the share of all relabellings that correlate at least as much as the true one, which counts among them."""
    seen = orders.where(F.col("order") == 0).select(F.col("rho").alias("observed"))
    n = F.count(F.lit(1))
    return orders.join(F.broadcast(seen)).agg(F.first("observed").alias("observed"), (F.count_if(F.col("rho") >= F.col("observed") - 1e-12) / n).alias("p"), n.alias("orders"))


def tail(draws: DataFrame, value: str, observed: float | None = None) -> DataFrame:
    """(observed, p_upper, p_lower, draws) with one added to both counts; replicate 0 is the observed value unless given."""
    seen = F.lit(observed) if observed is not None else F.max(F.when(F.col("replicate") == 0, F.col(value)))
    each = draws.agg(seen.alias("observed"))
    null = draws.where("replicate > 0").join(F.broadcast(each))
    n = F.count(F.lit(1))
    p = lambda hit: (1 + F.count_if(hit)) / (n + 1)
    return null.agg(F.first("observed").alias("observed"), p(F.col(value) >= F.col("observed")).alias("p_upper"), p(F.col(value) <= F.col("observed")).alias("p_lower"), n.alias("draws"))


def null_ratios(spark: SparkSession, sample: np.ndarray, count: int, seed: int, kind: str) -> DataFrame:
    """(replicate, pr, top): participation ratio and largest eigenvalue of a two-way-centred sample under a null.

    kind: `columns` shuffles each column, `gaussian` adds normal noise of each residual sd to the
    additive part, `rows` keeps each residual row's norm in a random zero-sum direction. The sample's rows are bounded by the caller.
    """
    x = np.asarray(sample, float)
    row, col, grand = x.mean(1, keepdims=True), x.mean(0, keepdims=True), x.mean()
    rest = x - row - col + grand

    def measure(y: np.ndarray) -> dict[str, float]:
        y = y - y.mean(1, keepdims=True) - y.mean(0, keepdims=True) + y.mean()
        w = np.clip(np.linalg.eigvalsh(np.corrcoef(y, rowvar=False)), 0, None)
        return {"pr": float(w.sum() ** 2 / (w**2).sum()), "top": float(w[-1])}

    def draw(r: int) -> dict[str, float]:
        rng = np.random.default_rng([seed, r])
        if r == 0:
            return measure(x)
        if kind == "columns":
            return measure(rng.permuted(x, axis=0))
        if kind == "gaussian":
            return measure(row + col - grand + rng.normal(size=x.shape) * rest.std(0, ddof=1))
        d = rng.normal(size=x.shape)
        d -= d.mean(1, keepdims=True)
        return measure(d / np.linalg.norm(d, axis=1, keepdims=True) * np.linalg.norm(rest, axis=1, keepdims=True))

    return replicates(spark, count + 1, draw, ["pr", "top"])


def keyed(rows: DataFrame, seed: int) -> DataFrame:
    """(key, x): rows under a hash of seed and entity, from which every draw of the row follows."""
    return rows.select(F.xxhash64(F.lit(seed), "entity").alias("key"), "x")


def hashed(key: np.ndarray, replicate: int, width: int) -> np.ndarray:
    """`width` numbers in (0, 1) for each 64-bit key, which key and replicate determine (the mixer of splitmix64)."""
    step = np.uint64(0x9E3779B97F4A7C15)

    def mixed(z: np.ndarray) -> np.ndarray:
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return z ^ (z >> np.uint64(31))

    at = mixed(np.asarray(key, np.int64).view(np.uint64) + np.array([replicate + 1], np.uint64) * step)
    z = mixed(at[:, None] + np.arange(1, width + 1, dtype=np.uint64) * step)
    return ((z >> np.uint64(12)).astype(float) + 0.5) / float(1 << 52)


def _normal(key: np.ndarray, replicate: int, width: int) -> np.ndarray:
    u = hashed(key, replicate, 2 * width)
    return np.sqrt(-2 * np.log(u[:, :width])) * np.cos(2 * np.pi * u[:, width:])


def poisson_weights(key: np.ndarray, replicate: int) -> np.ndarray:
    """How often each row is drawn: Poisson counts of mean one, the limit of draws with replacement, without a pass for their total."""
    steps = np.cumsum([math.exp(-1) / math.factorial(k) for k in range(20)])
    return np.searchsorted(steps, hashed(key, replicate, 1)[:, 0]).astype(float)


def _whole(batches: Iterator[pd.DataFrame], block: str | None) -> Iterator[pd.DataFrame]:
    """Batches as they come, or one frame for each block of rows that follow each other."""
    held = None
    for b in batches:
        if not block:
            yield b
            continue
        held = b if held is None else pd.concat([held, b])
        parts = [part for _, part in held.groupby(block, sort=False)]
        yield from parts[:-1]
        held = parts[-1] if parts else None
    if held is not None:
        yield held


def drawn_moments(rows: DataFrame, features: int, replicates: list[int], draw: Callable, block: str | None = None) -> DataFrame:
    """(replicate, i, j, moments): pair moments of every replicate over all rows, in one pass.

    `draw(r, key, x)` gives a batch's values and weights (or None) in replicate r. With `block` a call gets
    a whole block, and `key` is the block; the rows must lie together. A task emits one table a
    replicate, so small partitions are read together, two tasks a core.
    """
    upper = np.triu_indices(features, 1)
    key = block or "key"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[int, np.ndarray] = {}
        for b in _whole(batches, block):
            if len(b):
                x = np.array([np.asarray(r, float) for r in b["x"]]).reshape(len(b), features)
                k = b[key].to_numpy()
                for r in replicates:
                    held[r] = joined(held.get(r), batch_state(*draw(r, k, x)))
        for r, one in held.items():
            yield pd.DataFrame({"replicate": r, "i": upper[0], "j": upper[1]} | {c: one[k][upper] for k, c in enumerate(STATE)})

    schema = "replicate long, i int, j int, " + ", ".join(f"{c} double" for c in STATE)
    few = rows.select(key, "x").coalesce(2 * max(1, rows.sparkSession.sparkContext.defaultParallelism))
    return merged(few.mapInPandas(run, schema), ["replicate", "i", "j"])


def _row_centred(x: np.ndarray) -> np.ndarray:
    return x - np.nanmean(x, axis=1, keepdims=True)


def dealt_columns(rows: DataFrame, features: int, seed: int, block: int = BLOCK) -> DataFrame:
    """(block, x): every column dealt anew over all rows, by the order of its own hashes; rows of a block lie together.

    Cells are numbered within buckets of their hash, with the buckets before them added, so that no task numbers a column.
    """
    k = rows.select(F.xxhash64(F.lit(seed), "entity").alias("key"), F.posexplode("x").alias("feature", "value"))
    k = k.withColumn("h", F.xxhash64(F.lit(seed + 1), "feature", "key")).withColumn("b", F.pmod("h", F.lit(256)))
    n = k.groupBy("feature", "b").agg(F.count(F.lit(1)).alias("n"))
    before = n.select("feature", "b", (F.sum("n").over(Window.partitionBy("feature").orderBy("b")) - F.col("n")).alias("before"))
    at = F.row_number().over(Window.partitionBy("feature", "b").orderBy("h", "key")) - 1
    placed = k.withColumn("at", at).join(F.broadcast(before), ["feature", "b"]).select((F.col("at") + F.col("before")).alias("entity"), "feature", "value")
    dealt = rows_of(placed, list(range(features))).withColumn("block", F.floor(F.col("entity") / block))
    return dealt.repartition("block").sortWithinPartitions("block", "entity").select("block", "x")


def null_moments(rows: DataFrame, features: int, count: int, seed: int, kind: str, block: int = BLOCK) -> DataFrame:
    """(replicate, i, j, moments) of row-centred rows, all of them; replicate 0 is the observed matrix.

    kind: `columns` shuffles each column (dealt over all rows once, then shuffled within blocks in every
    replicate), `gaussian` has normal noise of each two-way residual's sd, `rows` keeps each residual row's
    norm in a random zero-sum direction. Additive parts drop out: row parts by centring, column parts in the moments.
    """
    k, later = keyed(rows, seed), list(range(1, count + 1))
    seen = drawn_moments(k, features, [0], lambda r, key, x: (_row_centred(x), None))
    if kind == "columns":

        def shuffle(r: int, b: np.ndarray, x: np.ndarray) -> tuple:
            return _row_centred(np.random.default_rng([seed, r, int(b[0])]).permuted(x, axis=0)), None

        return seen.union(drawn_moments(dealt_columns(rows, features, seed, block), features, later, shuffle, "block"))
    own = {}
    for r in seen.where("i = 0").select("i", "j", *STATE).collect():
        own |= {r["i"]: (r["n"], r["mx"], r["cxx"]), r["j"]: (r["n"], r["my"], r["cyy"])}
    n, mean, square = (np.array([own[f][c] if f in own else np.nan for f in range(features)]) for c in range(3))
    sd = np.sqrt(square / (n - 1))

    def noise(r: int, key: np.ndarray, x: np.ndarray) -> tuple:
        d = _normal(key, r, features)
        if kind == "gaussian":
            return _row_centred(d * sd), None
        d = _row_centred(d)
        size = np.linalg.norm(_row_centred(x) - mean, axis=1, keepdims=True)
        return d / np.linalg.norm(d, axis=1, keepdims=True) * size, None

    return seen.union(drawn_moments(k, features, later, noise))


def spectra(moments: DataFrame, features: int) -> DataFrame:
    """(replicate, w): eigenvalues of each replicate's correlation matrix, largest first; a pair without spread counts as 0.

    They pass through the driver, so that no use of them reads the rows again.
    """

    def run(part: pd.DataFrame) -> pd.DataFrame:
        c = np.eye(features)
        i, j = part["i"].to_numpy(), part["j"].to_numpy()
        c[i, j] = c[j, i] = part["r"].fillna(0.0).to_numpy()
        return pd.DataFrame({"replicate": part["replicate"].iloc[:1], "w": [np.clip(np.linalg.eigvalsh(c)[::-1], 0, None).tolist()]})

    schema = "replicate long, w array<double>"
    found = moments.select("replicate", "i", "j", correlation().alias("r")).groupBy("replicate").applyInPandas(run, schema)
    return moments.sparkSession.createDataFrame(found.collect(), schema)


def row_bootstrap(rows: DataFrame, features: int, count: int, seed: int, tries: int = 50) -> DataFrame:
    """(replicate, pr): participation ratio of all rows under drawn counts; a draw with a constant column is drawn again.

    Only pair tables' sums, one number a replicate, come to the driver between draws.
    """
    k, p = keyed(rows, seed), float(features)
    left, done = list(range(count)), []
    for attempt in range(tries):
        if not left:
            break
        m = drawn_moments(k, features, [attempt * count + r for r in left], lambda r, key, x: (x, poisson_weights(key, r)))
        r = m.select("replicate", correlation().alias("r")).groupBy("replicate")
        held = r.agg(F.sum(F.col("r") * F.col("r")).alias("q"), F.count_if(F.col("r").isNull()).alias("missing")).collect()
        done += [(x["replicate"] % count, p * p / (p + 2 * x["q"])) for x in held if not x["missing"]]
        left = sorted(set(range(count)) - {r for r, _ in done})
    return rows.sparkSession.createDataFrame(done, "replicate long, pr double")


def supports(rows: DataFrame, sizes: list[int], count: int, seed: int) -> DataFrame:
    """(replicate, size, x): in replicate r the sizes[r % len(sizes)] rows of least hash among all rows, in one pass.

    A task keeps only as many rows a replicate as its size, so few rows are ranked.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[int, pd.DataFrame] = {}
        for b in batches:
            for r in range(count):
                size = sizes[r % len(sizes)]
                h = hashed(b["key"].to_numpy(), r, 1)[:, 0]
                near = np.argsort(h, kind="stable")[:size]
                part = pd.DataFrame({"replicate": r, "size": size, "h": h[near], "key": b["key"].to_numpy()[near], "x": b["x"].to_numpy()[near]})
                held[r] = (pd.concat([held[r], part]) if r in held else part).nsmallest(size, "h")
        yield from held.values()

    near = keyed(rows, seed).mapInPandas(run, "replicate long, size long, h double, key long, x array<double>")
    place = F.row_number().over(Window.partitionBy("replicate").orderBy("h", "key"))
    return near.withColumn("place", place).where("place <= size").select("replicate", "size", "x")


def _traded(m: np.ndarray, rng: np.random.Generator, passes: int) -> np.ndarray:
    """Rows in random pairs trade what they don't share, each row once a pass; an odd row waits."""
    m = m.copy()
    for _ in range(passes):
        order = rng.permutation(len(m))
        a, b = order[: len(m) // 2], order[len(m) // 2 : len(m) // 2 * 2]
        differ = m[a] ^ m[b]
        place = np.where(differ, rng.random(differ.shape), 2.0).argsort(1).argsort(1)
        take = differ & (place < (m[a] & differ).sum(1)[:, None])
        both = m[a] & m[b]
        m[a], m[b] = both | take, both | (differ & ~take)
    return m


def traded(rows: DataFrame, features: int, count: int, seed: int, rounds: int = 3, passes: int = 4, block: int = BLOCK) -> DataFrame:
    """(replicate, x): random incidences (0 or 1) with the margins of all rows of `rows` (null is absent), for replicates 1 to count.

    In each round rows are dealt by hash to blocks, and trade within these; trades keep both margins, so blocks do.
    """
    blocks = max(1, -(-rows.count() // block))
    now = rows.select("entity", F.transform("x", lambda v: (v.isNotNull() & ~F.isnan(v)).cast("double")).alias("x"))
    now = now.withColumn("replicate", F.explode(F.sequence(F.lit(1), F.lit(count)).cast("array<bigint>")))
    kind = rows.schema["entity"].dataType.simpleString()

    def trade(t: int) -> Callable[[pd.DataFrame], pd.DataFrame]:
        def run(part: pd.DataFrame) -> pd.DataFrame:
            part = part.sort_values("entity")
            m = np.array([np.asarray(v) for v in part["x"]]).reshape(len(part), features) > 0
            rng = np.random.default_rng([seed, int(part["replicate"].iloc[0]), t, int(part["b"].iloc[0])])
            return part[["entity", "replicate"]].assign(x=list(_traded(m, rng, passes).astype(float)))

        return run

    for t in range(rounds):
        dealt = now.withColumn("b", F.pmod(F.xxhash64(F.lit(seed), F.lit(t), "replicate", "entity"), F.lit(blocks)))
        now = dealt.groupBy("replicate", "b").applyInPandas(trade(t), f"entity {kind}, replicate long, x array<double>")
    return now.select("replicate", "x")


def swapped(incidence: np.ndarray, seed: int, trades: int) -> np.ndarray:
    """A random incidence with the same margins: rows trade what they don't share, one pair at a time."""
    rng, m = np.random.default_rng(seed), incidence.astype(bool).copy()
    for _ in range(trades):
        a, b = rng.choice(len(m), 2, replace=False)
        differ = np.flatnonzero(m[a] ^ m[b])
        if len(differ) > 1:
            keep = rng.permutation(differ)[: int(m[a, differ].sum())]
            m[a, differ], m[b, differ] = False, True
            m[a, keep], m[b, keep] = True, False
    return m


def bootstrap_means(df: DataFrame, cluster: str, value: str, count: int, seed: int) -> DataFrame:
    """(replicate, mean): ratio of cluster sums to counts under exponential cluster weights; clusters are summed once.

    Weights follow from (seed, replicate, cluster), so several values of one cluster share their draws.
    """
    part = df.groupBy(cluster).agg(F.sum(value).alias("s"), F.count(value).alias("n"))
    each = part.withColumn("replicate", F.explode(F.sequence(F.lit(0), F.lit(count - 1))))
    w = -F.log(uniform(seed, F.col("replicate"), F.col(cluster)))
    return each.withColumn("w", w).groupBy("replicate").agg((F.sum(F.col("w") * F.col("s")) / F.sum(F.col("w") * F.col("n"))).alias("mean"))


def interval(draws: DataFrame, value: str, by: list[str] | None = None) -> DataFrame:
    """Mean, sd and exact 2.5 and 97.5 percentiles of draws."""
    q = lambda p: F.percentile(value, p)
    return draws.groupBy(*(by or [])).agg(F.avg(value).alias("mean"), F.stddev_samp(value).alias("sd"), q(0.025).alias("low"), q(0.975).alias("high"))


def detectable(sd: Column) -> Column:
    """The smallest effect found with 80 percent power by a two-sided test at 5 percent."""
    return (1.959964 + 0.841621) * sd


def equivalence(low: Column, high: Column) -> Column:
    """The smallest symmetric margin that an interval lies in."""
    return F.greatest(F.abs(low), F.abs(high))


def verdict(low: Column, high: Column, margin: float) -> Column:
    """better, worse, equivalent or undecided, from an interval and a margin."""
    return F.when(low > 0, "better").when(high < 0, "worse").when((low > -margin) & (high < margin), "equivalent").otherwise("undecided")


def without_each(pairs: DataFrame, features: int) -> DataFrame:
    """(dropped, pr): participation ratio without each feature, from the pair table's incident sums."""
    both = pairs.select(F.col("i").alias("dropped"), "r").union(pairs.select("j", "r"))
    own = both.groupBy("dropped").agg(F.sum(F.col("r") * F.col("r")).alias("q"))
    total = pairs.agg(F.sum(F.col("r") * F.col("r")).alias("t"))
    p = float(features - 1)
    return own.join(total).select("dropped", (p * p / (p + 2 * (F.col("t") - F.col("q")))).alias("pr"))


def jackknife(values: DataFrame, value: str, whole: float | None = None) -> DataFrame:
    """Standard error, bias and normal 95 percent interval from delete-one values, and the most influential one."""
    mean = values.agg(F.avg(value).alias("m"), F.count(F.lit(1)).alias("n"))
    x = values.join(mean)
    d = F.col(value) - F.col("m")
    s = x.agg(F.first("m").alias("mean"), F.first("n").alias("n"), F.sqrt((F.first("n") - 1) / F.first("n") * F.sum(d * d)).alias("se"), F.max_by("dropped", F.struct(F.abs(d), -F.col("dropped"))).alias("influential"))
    centre = F.lit(whole) if whole is not None else F.col("mean")
    return s.select("n", "mean", "se", "influential", ((F.col("n") - 1) * (F.col("mean") - centre)).alias("bias"), (centre - 1.959964 * F.col("se")).alias("low"), (centre + 1.959964 * F.col("se")).alias("high"))


def hash_fold(key: Column, seed: int, folds: int) -> Column:
    """A fold from the first 64 bits of SHA-256 of `seed|key`, unsigned: the same on any engine."""
    digest = F.sha2(F.concat(F.lit(f"{seed}|"), key.cast("string")), 256)
    return F.pmod(F.conv(F.substring(digest, 1, 16), 16, 10).cast("decimal(20,0)"), F.lit(folds)).cast("int")


def hash_order(key: Column, seed: int) -> Column:
    """A text to sort by for an order that the seed and key alone determine."""
    return F.sha2(F.concat(F.lit(f"{seed}|"), key.cast("string")), 256)


def lightest_blocks(sizes: DataFrame, group: str, size: str, blocks: int) -> DataFrame:
    """(group, block): whole groups, largest first, each to the block with least so far.

    Groups of one size are dealt round the blocks, so the greedy step runs on distinct sizes; group rows stay in Spark.
    """
    n = sizes.groupBy(size).agg(F.count(F.lit(1)).alias("c")).orderBy(F.desc(size)).collect()
    load = [0] * blocks
    starts = {}
    for s, c in n:
        order = sorted(range(blocks), key=lambda b: (load[b], b))
        starts[s] = order
        for k, b in enumerate(order):
            load[b] += s * (c // blocks + (k < c % blocks))
    deal = sizes.sparkSession.createDataFrame([(int(s), o) for s, o in starts.items()], "_size long, _order array<int>")
    order = [F.col(group).asc()]
    placed = carried(ranged(sizes.select(group, size), [size], order), [size], order, "_nth", F.lit(1)).withColumn("_at", F.col("_nth") - 1)
    dealt = placed.join(F.broadcast(deal), F.col(size) == F.col("_size"))
    return dealt.select(group, size, F.get("_order", (F.col("_at") % blocks).cast("int")).alias("block"))


def disjoint_supports(df: DataFrame, key: str, seed: int, size: int, supports: int) -> DataFrame:
    """(key, support): the first size * supports rows in hash order, dealt round the supports."""
    k = numbered(df.select(key).distinct().withColumn("_h", hash_order(F.col(key), seed)), [], "_h", "_at")
    return k.where(F.col("_at") < size * supports).select(key, (F.col("_at") % supports).cast("int").alias("support"))


def orders_of(sizes: list[int]) -> int:
    """Distinct relabellings within blocks of these sizes."""
    return math.prod(math.factorial(s) for s in sizes)


def _t_beside(y: np.ndarray, x: np.ndarray, z: np.ndarray) -> float:
    """t of x in the least-squares fit of y on a constant, x and z."""
    a = np.column_stack([np.ones(len(y)), x, z])
    inverse = np.linalg.pinv(a.T @ a)
    b = inverse @ a.T @ y
    rest = y - a @ b
    return float(b[1] / np.sqrt(rest @ rest / (len(y) - 3) * inverse[1, 1]))


def semi_partialled(spark: SparkSession, y: np.ndarray, x: np.ndarray, z: np.ndarray, count: int, seed: int) -> DataFrame:
    """(replicate, response, predictor): t of pair matrix x for y beside z after relabelling; replicate 0 isn't relabelled.

    `response` relabels y; `predictor` relabels what is left of x after z (double semi-partialling). In replicate 0 both are equal.
    """
    p = len(y)
    up = np.triu_indices(p, 1)
    fixed = np.column_stack([np.ones(len(up[0])), z[up]])
    left = np.zeros((p, p))
    left[up] = x[up] - fixed @ np.linalg.lstsq(fixed, x[up], rcond=None)[0]
    left += left.T

    def draw(r: int) -> dict[str, float]:
        order = np.random.default_rng([seed, r]).permutation(p) if r else np.arange(p)
        moved = np.ix_(order, order)
        return {"response": _t_beside(y[moved][up], x[up], z[up]), "predictor": _t_beside(y[up], left[moved][up], z[up])}

    return replicates(spark, count + 1, draw, ["response", "predictor"])


def matched_subspaces(spark: SparkSession, c: np.ndarray, modes: int, label: np.ndarray, count: int, seed: int) -> DataFrame:
    """(replicate, auc): how the kernel of leading modes finds labelled pairs; from replicate 1 its axes are random, its eigenvalues kept."""
    w, v = np.linalg.eigh(c)
    w, v, up = w[-modes:], v[:, -modes:], np.triu_indices(len(c), 1)

    def draw(r: int) -> dict[str, float]:
        axes = v
        if r:
            q, t = np.linalg.qr(np.random.default_rng([seed, r]).normal(size=v.shape))
            axes = q * np.sign(np.diag(t))
        k = (axes * w) @ axes.T
        d = np.sqrt(np.clip(np.diag(k), 1e-12, None))
        return {"auc": pair_auc((k / np.outer(d, d))[up], label)}

    return replicates(spark, count + 1, draw, ["auc"])


def refitted(y: np.ndarray, candidate: np.ndarray, prior: np.ndarray, shares: list[float], gates: list[float]) -> float:
    """How much a candidate adds to a prior in a linear model of pairs: the gain of mean AUC over several shares of strongest pairs.

    The candidate counts where it is at or above a quantile; of those `gates` the best is taken.
    """
    labels = [strongest(y, s) for s in shares]

    def score(*x: np.ndarray) -> float:
        z = np.column_stack([np.ones(len(y)), *x])
        fit = z @ np.linalg.lstsq(z, y, rcond=None)[0]
        return float(np.mean([pair_auc(fit, t) for t in labels]))

    gated = [np.where(candidate >= np.quantile(candidate, g), candidate, 0.0) for g in gates]
    return max(score(prior, x) for x in gated) - score(prior)


def refit_relabelled(spark: SparkSession, y: np.ndarray, x: np.ndarray, prior: np.ndarray, count: int, seed: int, shares: list[float], gates: list[float]) -> DataFrame:
    """(replicate, gain): the candidate alone is relabelled; model and gate are fitted anew in each replicate; replicate 0 isn't relabelled."""
    p, target, before = len(x), _upper(y), _upper(prior)

    def draw(r: int) -> dict[str, float]:
        order = np.random.default_rng([seed, r]).permutation(p) if r else np.arange(p)
        return {"gain": refitted(target, _upper(x[np.ix_(order, order)]), before, shares, gates)}

    return replicates(spark, count + 1, draw, ["gain"])
