"""k nearest neighbours on a partition of space that follows the density of the points.

A k-d tree, split at medians of a bounded sample, cuts space into leaves of about equally
many points, so a cluster is many small leaves and a far point is one more row of some
leaf. A query first searches its home leaf; the k-th distance found there bounds what can still be
nearer, and only leaves whose box of actual points begins within it are searched
too. In a task, points and queries of a leaf are cut into buckets by the same rule and met bucket by
bucket, nearest boxes first.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from geomill.operators.graph import cut

AXES = ("x", "y", "z")
#: Points of a leaf, at most about so many leaves (the tree and their boxes, some 5 MB, go to every task; with more points leaves grow), and sampled points for each.
LEAF, LEAVES, SAMPLED = 4096, 1 << 16, 16
#: Points of a bucket; queries of a leaf that go to one task.
BUCKET, CHUNK = 64, 1 << 15
#: Sampled points at one place from which on only the k least ids of the place take part.
HOT = SAMPLED // 2


@dataclass
class Tree:
    """Splits of a complete binary tree, numbered from 1; what is over the threshold goes to 2n + 1."""

    axis: np.ndarray
    threshold: np.ndarray
    depth: int

    def leaf(self, xyz: np.ndarray) -> np.ndarray:
        node, row = np.ones(len(xyz), np.int64), np.arange(len(xyz))
        for _ in range(self.depth):
            node = 2 * node + (xyz[row, self.axis[node]] > self.threshold[node])
        return node - (1 << self.depth)


def split(sample: np.ndarray, depth: int) -> Tree:
    """Median splits on the widest axis."""
    axis, threshold = np.zeros(1 << depth, np.int64), np.full(1 << depth, np.inf)
    parts = {1: sample}
    for node in range(1, 1 << depth):
        part = parts.pop(node)
        if len(part) > 1:
            axis[node] = np.ptp(part, axis=0).argmax()
            threshold[node] = np.partition(part[:, axis[node]], (len(part) - 1) // 2)[(len(part) - 1) // 2]
        over = part[:, axis[node]] > threshold[node]
        parts[2 * node], parts[2 * node + 1] = part[~over], part[over]
    return Tree(axis, threshold, depth)


def buckets(xyz: np.ndarray, size: int = BUCKET, wide: float = np.inf) -> tuple[np.ndarray, np.ndarray]:
    """An order of the rows and the ends of its buckets of near rows; a bucket wider than `wide` has one row."""
    order, ends, left = np.arange(len(xyz)), [0], [(0, len(xyz))] if len(xyz) else []
    while left:
        low, high = left.pop()
        if high - low <= size and (high - low == 1 or wide == np.inf or np.ptp(xyz[order[low:high]], axis=0).max() <= wide):
            ends.append(high)
            continue
        own = order[low:high]
        part = xyz[own]
        half = (high - low) // 2
        order[low:high] = own[np.argpartition(part[:, np.ptp(part, axis=0).argmax()], half)]
        left += [(low + half, high), (low, low + half)]
    return order, np.array(ends)


def _gap2(low: np.ndarray, high: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances of boxes from the box [a, b], never over that of any two points in them."""
    g = np.maximum(np.maximum(low - b, a - high), 0)
    return g[..., 0] ** 2 + g[..., 1] ** 2 + g[..., 2] ** 2


def _d2(q: np.ndarray, p: np.ndarray) -> np.ndarray:
    d = [p[None, :, i] - q[:, i, None] for i in range(3)]
    return d[0] * d[0] + d[1] * d[1] + d[2] * d[2]


def search(points: np.ndarray, queries: np.ndarray, k: int, bound: np.ndarray, within: float | None = None) -> tuple[np.ndarray, np.ndarray, int]:
    """Rows and squared distances of the k nearest points of each query, by (d2, row), at most `bound` (and under `within`) away; -1 and infinity where there are fewer; and how many pairs were met."""
    n = len(queries)
    row, dist, pairs = np.full((n, k), -1), np.full((n, k), np.inf), 0
    if not len(points) or not n:
        return row, dist, pairs
    order, ends = buckets(points)
    moved = points[order]
    low, high, size = np.minimum.reduceat(moved, ends[:-1]), np.maximum.reduceat(moved, ends[:-1]), np.diff(ends)
    # Sparser queries go in smaller buckets, so that theirs are about as wide as those of the points.
    qorder, qends = buckets(queries, int(np.clip(BUCKET * n // len(points), 2, BUCKET)))
    left = [qorder[a:b] for a, b in zip(qends[:-1], qends[1:])]
    while left:
        own = left.pop()
        x = queries[own]
        near = _gap2(low, high, x.min(axis=0), x.max(axis=0))
        limit = bound[own].max()
        first = np.argsort(near, kind="stable")
        enough = int(np.searchsorted(np.cumsum(size[first]), k)) + 1
        if enough <= len(first):
            some = np.concatenate([order[ends[b] : ends[b + 1]] for b in first[:enough]])
            limit = min(limit, np.partition(_d2(x, points[some]), k - 1, axis=1)[:, k - 1].max())
            pairs += len(own) * len(some)
        take = np.flatnonzero(near <= limit)
        if len(own) > 1 and size[take].sum() > 64 * BUCKET:
            left += list(own[:, None])  # one of them is far from the rest, or the points are denser here than the queries
            continue
        if not len(take):
            continue
        some = np.sort(np.concatenate([order[ends[b] : ends[b + 1]] for b in take]))
        d2 = _d2(x, points[some])
        pairs += d2.size
        keep = d2 <= bound[own][:, None]
        if len(some) > k:
            keep &= d2 <= np.partition(d2, k - 1, axis=1)[:, k - 1 : k]
        if within is not None:
            keep &= d2 < within
        r, c = np.nonzero(keep)
        o = np.lexsort((c, d2[r, c], r))
        r, c = r[o], c[o]
        rank = np.arange(len(r)) - np.searchsorted(r, r)
        r, c, rank = r[rank < k], c[rank < k], rank[rank < k]
        row[own[r], rank], dist[own[r], rank] = some[c], d2[r, c]
    return row, dist, pairs


def _xyz(table: pa.Table | pa.RecordBatch, names: tuple[str, ...] = AXES) -> np.ndarray:
    return np.stack([table.column(c).to_numpy().astype(np.float64) for c in names], axis=1) if table.num_rows else np.zeros((0, 3))


def _placed(df: DataFrame, id_col: str, tree: Tree) -> DataFrame:
    """(leaf, id, x, y, z)"""
    schema = T.StructType([T.StructField("leaf", T.IntegerType()), T.StructField("id", df.schema[id_col].dataType), *(T.StructField(c, T.DoubleType()) for c in AXES)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array(tree.leaf(_xyz(b)), pa.int32()), *b.columns], names=schema.names)

    return df.select(F.col(id_col), *(F.col(c).cast("double") for c in AXES)).mapInArrow(run, schema)


def _thinned(points: DataFrame, hot: np.ndarray, k: int, id_col: str) -> DataFrame:
    """Points without those at hot places that aren't among the k of least id there: they can't be among a query's k nearest. Tasks keep k of each before the shuffle."""
    places = {tuple(p) for p in hot.tolist()}
    at = F.broadcast(points.sparkSession.createDataFrame(sorted(places), "x double, y double, z double"))
    rest, held = points.join(at, list(AXES), "left_anti"), points.join(at, list(AXES), "left_semi").select(id_col, *AXES)

    def least(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: dict[tuple, pa.Table] = {}
        for b in batches:
            table = pa.Table.from_batches([b])
            xyz = _xyz(b)
            for place in np.unique(xyz, axis=0):
                own = table.filter(pa.array((xyz == place).all(axis=1)))
                key = tuple(place.tolist())
                kept[key] = pa.concat_tables([kept[key], own] if key in kept else [own]).sort_by(id_col).slice(0, k)
        for table in kept.values():
            yield from table.combine_chunks().to_batches()

    few = held.mapInArrow(least, held.schema).withColumn("_r", F.row_number().over(Window.partitionBy(*AXES).orderBy(id_col)))
    return rest.select(id_col, *AXES).unionByName(few.filter(F.col("_r") <= k).drop("_r"))


def _chunked(points: DataFrame, queries: DataFrame, count: dict[int, int]) -> tuple[DataFrame, DataFrame]:
    """Both with `chunk`: queries of a leaf that has very many are dealt to several tasks, each with the leaf's points."""
    many = [(leaf, -(-n // CHUNK)) for leaf, n in count.items() if n > CHUNK]
    if not many:
        return points.withColumn("chunk", F.lit(0)), queries.withColumn("chunk", F.lit(0))
    parts = F.broadcast(points.sparkSession.createDataFrame(many, "leaf int, parts int"))
    of = F.coalesce("parts", F.lit(1))
    return points.join(parts, "leaf", "left").withColumn("chunk", F.explode(F.sequence(F.lit(0), of - 1))).drop("parts"), queries.join(parts, "leaf", "left").withColumn("chunk", F.pmod(F.xxhash64("id", *AXES), of).cast("int")).drop("parts")


def _homes(n: np.ndarray, k: int) -> np.ndarray:
    """The leaf that queries of each leaf begin with: itself, or, if it has fewer than k points, the fullest of the smallest subtree around it that has one with k."""
    home = np.arange(len(n))
    for i in np.flatnonzero(n < k):
        width = 2
        while width <= len(n):
            first = i // width * width
            best = first + int(n[first : first + width].argmax())
            if n[best] >= k or width == len(n):
                home[i] = best
                break
            width *= 2
    return home


def knn(points: DataFrame, queries: DataFrame, k: int, point_id: str, query_id: str, within: float | None = None) -> DataFrame:
    """(query_id, point_id, d2, rank): the k nearest points with finite places (under `within` squared away), ties by id.

    The sample and one row a leaf reach the driver; each query sends k rows for each leaf it visits.
    """
    spark = points.sparkSession
    points = points.select(point_id, *(F.col(c).cast("double") for c in AXES))
    total = points.count()
    leaf_size = max(LEAF, 4 * k, total // LEAVES)
    depth = max(0, int(np.ceil(np.log2(max(1, total / leaf_size)))))
    sample = np.zeros((0, 3))
    if depth:
        few = points.select(*AXES).sample(min(1.0, (SAMPLED << depth) / total), 7).toArrow()
        sample, times = np.unique(_xyz(few), axis=0, return_counts=True) if few.num_rows else (sample, np.zeros(0))
        if len(sample) and times.max() >= HOT:
            points = _thinned(points, sample[times >= HOT], k, point_id)
    tree = split(sample, depth)
    held, asked = cut(_placed(points, point_id, tree)), _placed(queries, query_id, tree)
    both = held.select("leaf", *AXES, F.lit(1).alias("p")).unionByName(asked.select("leaf", *(F.lit(None).cast("double").alias(c) for c in AXES), F.lit(0).alias("p")))
    stats = both.groupBy("leaf").agg(F.sum("p").alias("n"), F.sum(1 - F.col("p")).alias("q"), *(f(c).alias(f"{s}{c}") for s, f in (("lo", F.min), ("hi", F.max)) for c in AXES)).collect()
    n, low, high = np.zeros(1 << depth, np.int64), np.full((1 << depth, 3), np.inf), np.full((1 << depth, 3), -np.inf)
    for r in stats:
        n[r["leaf"]] = r["n"]
        if r["n"]:
            low[r["leaf"]], high[r["leaf"]] = [r[f"lo{c}"] for c in AXES], [r[f"hi{c}"] for c in AXES]
    home = _homes(n, k)
    count: dict[int, int] = {}
    for r in stats:
        count[int(home[r["leaf"]])] = count.get(int(home[r["leaf"]]), 0) + r["q"]
    if (home != np.arange(len(home))).any():
        moved = F.broadcast(spark.createDataFrame([(int(i), int(h)) for i, h in enumerate(home)], "leaf int, home int"))
        asked = asked.join(moved, "leaf").select(F.col("home").alias("leaf"), "id", *AXES)
    ids, qids = held.schema["id"].dataType, asked.schema["id"].dataType
    best = [T.StructField("ids", T.ArrayType(ids)), T.StructField("d2s", T.ArrayType(T.DoubleType()))]
    schema = T.StructType([T.StructField("id", qids), *(T.StructField(c, T.DoubleType()) for c in AXES), T.StructField("bound", T.DoubleType()), *best, T.StructField("leaves", T.ArrayType(T.IntegerType()))])
    top = np.inf if within is None else within

    def lists(p: pa.Table, row: np.ndarray, dist: np.ndarray) -> list[pa.Array]:
        found = row >= 0
        ends = pa.array(np.append(0, np.cumsum(found.sum(axis=1))), pa.int32())
        flat = p["id"].combine_chunks().take(pa.array(row[found]))
        return [pa.ListArray.from_arrays(ends, flat), pa.ListArray.from_arrays(ends, pa.array(dist[found]))]

    def at_home(p: pa.Table, q: pa.Table) -> pa.Table:
        p = p.sort_by("id")
        x = _xyz(q)
        row, dist, _ = search(_xyz(p), x, k, np.full(len(x), top), within)
        bound = np.minimum(dist[:, k - 1], top)
        own = q["leaf"][0].as_py() if len(x) else -1
        also: list[list[int]] = [[]] * len(x)
        order, ends = buckets(x)
        for a, b in zip(ends[:-1], ends[1:]):
            rows = order[a:b]
            near = np.flatnonzero((n > 0) & (_gap2(low, high, x[rows].min(axis=0), x[rows].max(axis=0)) <= bound[rows].max()))
            near = near[near != own]
            if len(near):
                for i in rows.tolist():
                    also[i] = near[_gap2(low[near], high[near], x[i], x[i]) <= bound[i]].tolist()
        return pa.table([q["id"], *(q[c] for c in AXES), pa.array(bound), *lists(p, row, dist), pa.array(also, pa.list_(pa.int32()))], names=schema.names)

    def elsewhere(p: pa.Table, q: pa.Table) -> pa.Table:
        p = p.sort_by("id")
        row, dist, _ = search(_xyz(p), _xyz(q), k, q["bound"].to_numpy(), within)
        return pa.table([q["id"], *lists(p, row, dist)], names=["id", "ids", "d2s"])

    # A task for about each leaf: these rows are few bytes but much work, so their number isn't left to sizes.
    tasks = max(len(n), spark.sparkContext.defaultParallelism)

    def met(p: DataFrame, q: DataFrame, run, result: T.StructType) -> DataFrame:
        p, q = (df.repartition(tasks, "leaf", "chunk").groupBy("leaf", "chunk") for df in (p, q))
        return p.cogroup(q).applyInArrow(run, result)

    first = cut(met(*_chunked(held, asked, count), at_home, schema))
    more = first.select("id", *AXES, "bound", F.explode("leaves").alias("leaf"))
    # A query visits a leaf once, so no leaf gets more queries than there are.
    count = {r["leaf"]: r["count"] for r in more.groupBy("leaf").count().collect()} if sum(r["q"] for r in stats) > CHUNK else {}
    other = met(*_chunked(held, more, count), elsewhere, T.StructType([schema["id"], *best]))
    apart = lambda df: df.select("id", F.inline(F.arrays_zip("ids", "d2s"))).toDF(query_id, point_id, "d2")
    single = first.filter(F.size("leaves") == 0).select(F.col("id").alias(query_id), F.posexplode(F.arrays_zip("ids", "d2s")).alias("at", "best")).select(query_id, F.col("best.ids").alias(point_id), F.col("best.d2s").alias("d2"), (F.col("at") + 1).alias("rank"))
    merged = apart(first.filter(F.size("leaves") > 0)).unionByName(apart(other))
    ranked = merged.withColumn("rank", F.row_number().over(Window.partitionBy(query_id).orderBy("d2", point_id))).filter(F.col("rank") <= k)
    return single.unionByName(ranked)
