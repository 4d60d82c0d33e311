"""Feature-by-feature geometry: pair moments, correlations, participation ratios and comparisons of pair tables."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..sources.tables import stored
from .moments import STATE, batch_state, correlation, covariance, joined, merged
from .ranks import average_rank, dealt, range_edges, value_ranks


#: Distinct value pairs of a range that a task counts concordance in.
RANGE = 250_000


def rows_of(cells: DataFrame, features: list, keep: list[str] | None = None) -> DataFrame:
    """One row for each entity with its values in feature order (null where absent), beside `keep` columns of the entity. Of repeated cells the greatest value stands.

    Tasks put a cell in its place before rows are shuffled, so an entity is one row from each task that had it.
    """
    known = cells.where(F.col("feature").isin(features) & F.col("value").isNotNull())
    placed = [F.max(F.when(F.col("feature") == F.lit(f), F.col("value"))) for f in features]
    return known.groupBy("entity", *(keep or [])).agg(F.array(*placed).alias("x"))


def values_of(column: pa.Array, features: int) -> np.ndarray:
    """An Arrow array of equally long lists as a matrix; nulls are NaN."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(column), features)


def pair_moments(rows: DataFrame, features: int, group: list[str] | None = None, weight: str | None = None) -> DataFrame:
    """(group, i, j, state) for i < j over entities that have both features: mergeable centred moments (`moments.STATE`).

    A batch of rows becomes a few matrix products, batches and tasks are merged about their own means, so what is shuffled is one small table for each
    task and group, and neither entities nor pairs of cells. Rows count by `weight` if it names a column.
    """
    group = group or []
    upper = np.triu_indices(features, 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, np.ndarray] = {}
        for b in (x for x in batches if len(x)):
            x = values_of(b.column("x"), features)
            w = b.column(weight).to_numpy(zero_copy_only=False) if weight else None
            parts = {(): np.arange(len(b))}
            if group:
                parts = b.select(group).to_pandas().groupby(group, dropna=False, sort=False).indices
            for key, at in parts.items():
                key = key if isinstance(key, tuple) else (key,)
                held[key] = joined(held.get(key), batch_state(x[at], None if w is None else w[at]))
        for key, one in held.items():
            out = pd.DataFrame({g: [key[k]] * len(upper[0]) for k, g in enumerate(group)} | {"i": upper[0], "j": upper[1]} | {c: one[k][upper] for k, c in enumerate(STATE)})
            yield pa.RecordBatch.from_pandas(out, schema=arrow, preserve_index=False)

    fields = [rows.schema[g] for g in group] + [T.StructField(c, T.IntegerType()) for c in ("i", "j")] + [T.StructField(c, T.DoubleType()) for c in STATE]
    schema = T.StructType(fields)
    arrow = to_arrow_schema(schema)
    parts = rows.select("x", *group, *([weight] if weight else [])).mapInArrow(run, schema)
    return merged(parts, [*group, "i", "j"])


def correlations(cells: DataFrame, features: list, group: list[str] | None = None, least: int = 2) -> DataFrame:
    """(group, i, j, n, r): the upper triangle in declared feature order, from entities that have both."""
    m = pair_moments(rows_of(cells, features, group), len(features), group)
    return m.where(F.col("n") >= least).select(*(group or []), "i", "j", F.col("n").cast("long").alias("n"), correlation().alias("r"))


def mirrored(pairs: DataFrame, value: str = "r") -> DataFrame:
    """Both triangles of a pair table."""
    return pairs.select("i", "j", value).union(pairs.select(F.col("j"), F.col("i"), value))


def participation(pairs: DataFrame, features: int, group: list[str] | None = None) -> DataFrame:
    """Participation ratio of the correlation matrix, squared trace over squared norm: no eigenvalues are needed."""
    p = float(features)
    q = F.sum(F.col("r") * F.col("r"))
    return pairs.groupBy(*(group or [])).agg((p * p / (p + 2 * q)).alias("pr"), F.avg(F.col("r") * F.col("r")).alias("mean_r2"), F.avg("r").alias("mean_r"))


def projected(covariances: DataFrame) -> DataFrame:
    """Row-centred covariances H C H from a full symmetric table (i, j, c): no centred cell is made."""
    to = covariances.groupBy("i").agg(F.avg("c").alias("m"))
    grand = covariances.agg(F.avg("c").alias("g"))
    a, b = to.select(F.col("i"), F.col("m").alias("mi")), to.select(F.col("i").alias("j"), F.col("m").alias("mj"))
    return covariances.join(a, "i").join(b, "j").join(grand).select("i", "j", (F.col("c") - F.col("mi") - F.col("mj") + F.col("g")).alias("c"))


def covariance_table(rows: DataFrame, features: int) -> DataFrame:
    """(i, j, c): sample covariances of complete rows as a full symmetric table with its diagonal, from one pass of moments."""
    m = pair_moments(rows, features).select("i", "j", "n", "cxx", "cyy", "cxy")
    own = m.groupBy("i").agg(F.max(F.try_divide("cxx", F.col("n") - 1)).alias("c")).select("i", F.col("i").alias("j"), "c")
    last = m.groupBy("j").agg(F.max(F.try_divide("cyy", F.col("n") - 1)).alias("c")).where(F.col("j") == features - 1).select(F.col("j").alias("i"), "j", "c")
    off = m.select("i", "j", F.try_divide("cxy", F.col("n") - 1).alias("c"))
    return off.union(off.select(F.col("j"), F.col("i"), F.col("c"))).union(own).union(last)


def from_covariances(c: DataFrame) -> DataFrame:
    """(i, j, r) for i < j: correlations from a full covariance table with its diagonal; null without spread."""
    own = c.where("i = j")
    a, b = own.select(F.col("i"), F.col("c").alias("ci")), own.select(F.col("i").alias("j"), F.col("c").alias("cj"))
    r = F.col("c") / F.sqrt("ci") / F.sqrt("cj")
    spread = (F.col("ci") > 0) & (F.col("cj") > 0)
    return c.where("i < j").join(F.broadcast(a), "i").join(F.broadcast(b), "j").select("i", "j", F.when(spread, F.greatest(F.lit(-1.0), F.least(F.lit(1.0), r))).alias("r"))


def _paired_state(u: np.ndarray) -> np.ndarray:
    """The state of u[:, i, j] beside u[:, j, i] for all i and j, over rows where both are numbers (`moments.STATE`)."""
    v = u.transpose(0, 2, 1)
    seen = ~np.isnan(u) & ~np.isnan(v)
    n = seen.sum(0).astype(float)
    share = np.divide(1.0, n, out=np.zeros_like(n), where=n > 0)
    mean = np.where(seen, u, 0.0).sum(0) * share
    x = np.where(seen, u - mean, 0.0)
    y = x.transpose(0, 2, 1)
    square, none = (x * x).sum(0), np.zeros_like(n)
    return np.stack([n, mean, mean.T, none, none, square, square.T, (x * y).sum(0)])


def pair_ranks(cells: DataFrame, features: list) -> DataFrame:
    """(entity, i, r): for each cell its average ranks within feature i, one for each other feature j among the entities that have j too (null where the entity lacks j).

    Presence counts of all features are summed for each distinct value of a feature and cumulated along its values: in a window over a range of
    values, plus what lower ranges hold. So ranks within every pair's own entities cost p numbers a cell, and no cell meets another entity's.
    """
    p = range(len(features))
    place = F.create_map(*[F.lit(x) for k, f in enumerate(features) for x in (f, k)])
    known = cells.where(F.col("feature").isin(features) & F.col("value").isNotNull()).select("entity", place[F.col("feature")].alias("i"), "value")
    held = known.groupBy("entity").agg(F.collect_list(F.struct("i", "value")).alias("all"))
    present = [F.array_contains("all.i", j).cast("long").alias(f"h{j}") for j in p]
    each = held.select("entity", F.explode("all").alias("c"), *present).select("entity", "c.i", "c.value", *[f"h{j}" for j in p])
    counts = each.groupBy("i", "value").agg(*[F.sum(f"h{j}").alias(f"n{j}") for j in p])
    # stored, so that the ranges don't change when they are read again
    ranged = stored(counts.repartitionByRange("i", "value").withColumn("part", F.spark_partition_id()), "presence")
    before = Window.partitionBy("i").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = ranged.groupBy("i", "part").agg(*[F.sum(f"n{j}").alias(f"s{j}") for j in p])
    lower = parts.select(F.col("i").alias("_i"), F.col("part").alias("_part"), *[F.coalesce(F.sum(f"s{j}").over(before), F.lit(0)).alias(f"b{j}") for j in p])
    upto = Window.partitionBy("part", "i").orderBy("value")
    ranks = ranged.select("i", "value", "part", *[(F.sum(f"n{j}").over(upto) - (F.col(f"n{j}") - 1) / 2.0).alias(f"u{j}") for j in p]).join(lower, (F.col("i") == F.col("_i")) & (F.col("part") == F.col("_part")))
    r = ranks.select("i", "value", F.array(*[F.col(f"u{j}") + F.col(f"b{j}") for j in p]).alias("r"))
    has = F.array(*[F.col(f"h{j}") for j in p])
    return each.select("entity", "i", "value", has.alias("has")).join(r, ["i", "value"]).select("entity", "i", F.zip_with("r", "has", lambda x, h: F.when(h > 0, x)).alias("r"))


def rank_correlations(cells: DataFrame, least: int = 3, features: list | None = None) -> DataFrame:
    """(i, j, n, rho): Spearman over entities that have both features, ranked within each pair's own entities (`pair_ranks`).

    An entity's rows of ranks meet in its own row, where each pair gives two numbers; tasks sum them to one table of features squared. A cell occurs once.
    Without `features` those of the table are taken, in order.
    """
    features = features or sorted(r[0] for r in cells.where(F.col("value").isNotNull()).select("feature").distinct().collect())
    if not features:
        kind = cells.schema["feature"].dataType.simpleString()
        return cells.sparkSession.createDataFrame([], f"i {kind}, j {kind}, n long, rho double")
    p = len(features)
    rows = pair_ranks(cells, features).groupBy("entity").agg(F.collect_list(F.struct("i", "r")).alias("all")).select(F.col("all.i").alias("at"), F.flatten("all.r").alias("r"))
    upper = np.triu_indices(p, 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for b in (x.slice(lo, 256) for x in batches for lo in range(0, len(x), 256)):
            at, r = b.column(0), b.column(1)
            u = np.full((len(b) * p, p), np.nan)
            row = np.repeat(np.arange(len(b)), np.diff(at.offsets.to_numpy()))
            u[row * p + at.flatten().to_numpy()] = r.flatten().to_numpy(zero_copy_only=False).reshape(-1, p)
            held = joined(held, _paired_state(u.reshape(len(b), p, p)))
        if held is not None:
            yield pa.RecordBatch.from_arrays([pa.array(x.astype(np.int32)) for x in upper] + [pa.array(held[k][upper]) for k in range(len(STATE))], ["i", "j", *STATE])

    parts = rows.mapInArrow(run, "i int, j int, " + ", ".join(f"{c} double" for c in STATE))
    names = F.array(*map(F.lit, features))
    m = merged(parts, ["i", "j"]).where(F.col("n") >= least)
    return m.select(F.get(names, F.col("i")).alias("i"), F.get(names, F.col("j")).alias("j"), F.col("n").cast("long").alias("n"), correlation().alias("rho"))


def spearman(df: DataFrame, x: str, y: str, by: list[str] | None = None) -> DataFrame:
    """Spearman correlation of two columns, in groups that a task can sort: pair tables and the like."""
    by = by or []
    ranked = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(*by, average_rank(by, x).alias("_x"), average_rank(by, y).alias("_y"))
    return ranked.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.corr("_x", "_y").alias("rho"))


def row_spearman(df: DataFrame, x: str, y: str, by: list[str] | None = None) -> DataFrame:
    """The same for groups of any size: ranks come from counts of distinct values, so no task holds a whole group."""
    by = by or []
    both = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(*by, F.col(x).alias("_u"), F.col(y).alias("_v"))
    ranks = lambda c, name: value_ranks(both, c, by).withColumnRenamed("rank", name)
    ranked = both.join(ranks("_u", "_x"), [*by, "_u"]).join(ranks("_v", "_y"), [*by, "_v"])
    return ranked.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.corr("_x", "_y").alias("rho"))


def _concordance(g: pd.DataFrame) -> pd.DataFrame:
    """The sum of c * c' * sign(y' - y) over a group's pairs with x < x'.

    Such a pair differs first in one bit of the ranks of x; at that bit each row with a one meets, by a sorted
    search, the rows of its block with a zero.
    """
    c, y = g["c"].to_numpy(float), np.unique(g["y"], return_inverse=True)[1]
    x, s = np.unique(g["x"], return_inverse=True)[1], 0.0
    for bit in range(int(x.max()).bit_length()):
        block = x >> (bit + 1)
        key = block * (int(y.max()) + 1) + y
        left = np.flatnonzero((x >> bit) & 1 == 0)
        left = left[np.argsort(key[left], kind="stable")]
        right = np.flatnonzero((x >> bit) & 1)
        upto = np.concatenate([[0.0], np.cumsum(c[left])])
        at = lambda k, side: upto[np.searchsorted(key[left], k, side)]  # noqa: E731, B023
        first, last = at(block[right] * (int(y.max()) + 1), "left"), at((block[right] + 1) * (int(y.max()) + 1), "left")
        s += float((c[right] * (at(key[right], "left") - first - last + at(key[right], "right"))).sum())
    return pd.DataFrame({"s": [s]})


def kendall(df: DataFrame, x: str, y: str) -> DataFrame:
    """Kendall's tau-b of two columns, in n log n: distinct value pairs with counts, dealt to ranges of either column.

    Pairs in different ranges of both columns are counted from the table of ranges; those in one range of y by x's
    ranges, and those in one range of x, within that range. A value with very many rows is a range of its own
    (`ranks.dealt`), which holds no pair to count. Rows with a null are left out.
    """
    v = stored(df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).groupBy(F.col(x).alias("x"), F.col(y).alias("y")).agg(F.count(F.lit(1)).alias("c")), "value-pairs")
    parts = max(64, -(-v.count() // RANGE))
    v = v.withColumns({"bx": dealt("x", range_edges(v, "x", parts)), "by": dealt("y", range_edges(v, "y", parts))})
    number = lambda c: F.col(c).cast("double").alias(c)
    counts = lambda *keys: v.groupBy(*keys).agg(F.sum("c").alias("c"))
    grid = counts("bx", "by").select(F.lit(0).alias("part"), F.lit(0).alias("at"), F.col("bx").cast("double").alias("x"), F.col("by").cast("double").alias("y"), "c")
    same_y = counts("by", "bx", "y").where("by % 2 = 0").select(F.lit(1), F.col("by"), F.col("bx").cast("double"), number("y"), "c")
    same_x = v.where("bx % 2 = 0").select(F.lit(2), F.col("bx"), number("x"), number("y"), "c")
    score = grid.union(same_y).union(same_x).groupBy("part", "at").applyInPandas(_concordance, "s double").agg(F.sum("s").alias("s"))
    tied = lambda c: v.groupBy(c).agg(F.sum("c").alias("t")).agg(F.sum(F.col("t") * (F.col("t") - 1) / 2).alias(f"t{c}"))
    n = v.agg((F.sum("c") * (F.sum("c") - 1) / 2).alias("n0"))
    return score.join(tied("x")).join(tied("y")).join(n).select((F.col("s") / F.sqrt((F.col("n0") - F.col("tx")) * (F.col("n0") - F.col("ty")))).alias("tau"))


def compared(a: DataFrame, b: DataFrame, features: int, share: float = 0.1) -> DataFrame:
    """How two pair tables agree: rank correlation, share of flipped signs, Jaccard index of their strongest pairs, both participation ratios."""
    j = a.select("i", "j", F.col("r").alias("x")).join(b.select("i", "j", F.col("r").alias("y")), ["i", "j"])
    k = F.greatest(F.lit(1), F.ceil(F.count(F.lit(1)).over(Window.partitionBy()) * F.lit(share)))
    top = lambda c: (F.row_number().over(Window.orderBy(F.desc(F.abs(F.col(c))), "i", "j")) <= k).cast("int")
    ranked = j.select("*", average_rank([], "x").alias("rx"), average_rank([], "y").alias("ry"), top("x").alias("tx"), top("y").alias("ty"))
    p = float(features)
    both, either = F.sum(F.col("tx") * F.col("ty")), F.sum(F.greatest("tx", "ty"))
    pr = lambda c: p * p / (p + 2 * F.sum(F.col(c) * F.col(c)))
    return ranked.agg(
        F.corr("rx", "ry").alias("rho"), (1 - F.corr("rx", "ry")).alias("distance"), F.avg((F.sign("x") != F.sign("y")).cast("int")).alias("flipped"),
        (both / either).alias("top_jaccard"), pr("x").alias("pr_a"), pr("y").alias("pr_b"), F.avg("x").alias("mean_a"), F.avg("y").alias("mean_b"),
        F.avg(F.abs("x")).alias("mean_abs_a"), F.avg(F.abs("y")).alias("mean_abs_b"),
    )


def shrinkage(squares: Column, trace: Column, n: Column, features: int) -> list[Column]:
    """The oracle-approximating weight of the scaled identity, and its scale, from a covariance's squared norm and trace."""
    p = float(features)
    up = (1 - 2 / p) * squares + trace * trace
    down = (n + 1 - 2 / p) * (squares - trace * trace / p)
    return [F.round(F.least(F.lit(1.0), up / down), 6).alias("shrinkage"), F.round(trace / p, 8).alias("target")]


def matrix(pairs: DataFrame, features: int, value: str = "r", diagonal: float = 1.0) -> np.ndarray:
    """A pair table as a symmetric array on the driver: features squared numbers."""
    out = np.full((features, features), 0.0)
    np.fill_diagonal(out, diagonal)
    for i, j, v in pairs.select("i", "j", value).collect():
        out[i, j] = out[j, i] = v
    return out


def spectrum(c: np.ndarray) -> dict[str, float]:
    """Eigenvalue summary of a correlation matrix: effective ranks, leading share, modes for 80 and 90 percent."""
    w = np.clip(np.linalg.eigvalsh(c)[::-1], 0, None)
    share = w / w.sum()
    grown = np.cumsum(share)
    some = share[share > 0]
    return {
        "pr": float(w.sum() ** 2 / (w**2).sum()), "entropy_rank": float(np.exp(-(some * np.log(some)).sum())), "pc1": float(share[0]),
        "modes_80": float(np.searchsorted(grown, 0.8) + 1), "modes_90": float(np.searchsorted(grown, 0.9) + 1),
    }


def leading_axis(c: np.ndarray) -> tuple[np.ndarray, float]:
    """Loadings of the first axis, signed so that their mean isn't negative, and their cosine with the uniform axis."""
    v = np.linalg.eigh(c)[1][:, -1]
    v = v if v.mean() >= 0 else -v
    return v, float(v.sum() / np.sqrt(len(v)))


def kernel(c: np.ndarray, modes: int) -> np.ndarray:
    """The part of a matrix in its first modes, scaled to a unit diagonal."""
    w, v = np.linalg.eigh(c)
    k = (v[:, -modes:] * w[-modes:]) @ v[:, -modes:].T
    d = np.sqrt(np.clip(np.diag(k), 1e-12, None))
    return k / np.outer(d, d)


def subspace_cosines(a: np.ndarray, b: np.ndarray, modes: int) -> np.ndarray:
    """Canonical correlations of the leading subspaces of two matrices."""
    u, v = (np.linalg.eigh(m)[1][:, -modes:] for m in (a, b))
    return np.clip(np.linalg.svd(u.T @ v, compute_uv=False), 0, 1)


def leaf_order(c: np.ndarray) -> list[int]:
    """Features in the order of an average-linkage tree on 1 - r, on the driver."""
    groups = {i: [i] for i in range(len(c))}
    d = 1 - c
    while len(groups) > 1:
        keys = sorted(groups)
        _, a, b = min((d[np.ix_(groups[x], groups[y])].mean(), x, y) for k, x in enumerate(keys) for y in keys[k + 1 :])
        groups[a] += groups.pop(b)
    return next(iter(groups.values()))


def pivot_features(c: np.ndarray, modes: int, count: int) -> list[int]:
    """Features picked by column-pivoted orthogonalisation of the leading eigenvectors."""
    v = np.linalg.eigh(c)[1][:, -modes:].T.copy()
    out: list[int] = []
    for _ in range(min(count, modes)):
        size = (v**2).sum(0)
        size[out] = -1
        k = int(size.argmax())
        out.append(k)
        q = v[:, k] / np.sqrt(max(size[k], 1e-300))
        v -= np.outer(q, q @ v)
    return out


def farthest_order(distance: np.ndarray, count: int) -> list[int]:
    """Greedy order in which each next item lies farthest from those before; it begins with the most remote on average."""
    out = [int(distance.mean(1).argmax())]
    while len(out) < min(count, len(distance)):
        near = distance[:, out].min(1)
        near[out] = -1
        out.append(int(near.argmax()))
    return out
