"""Neighbour joins in three dimensions: radius joins and nearest neighbours on k-d partitions.

A radius join sends each query to the leaves of points that its ball can touch (see `balls`).
Non-finite coordinates match nothing.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from geomill.operators import balls, kd
from geomill.operators.filters import finite
from geomill.operators.graph import cut

AXES = ("x", "y", "z")
#: Points of a cell that are searched at once.
HELD = 1 << 16


def cell(c: str, size: float) -> Column:
    return F.floor(F.col(c) / F.lit(size)).cast("long")


def radius_join(points: DataFrame, queries: DataFrame, radius: float, per_query: str | None = None, inclusive: bool = False, point_id: str = "point_id", query_id: str = "query_id") -> DataFrame:
    """(query_id, point_id, d2): points with d2 < r2 (or <=). With `per_query` each query has its own radius, at most `radius`. Rows are made where a query meets a leaf of points, and aren't shuffled."""
    extra = [F.col(per_query).cast("double").alias("own")] if per_query else []

    def pick(home: pa.Table, visitors: pa.Table, rows: np.ndarray, columns: np.ndarray, d2: np.ndarray) -> pa.Table:
        r = visitors["own"].to_numpy()[columns] if per_query else float(radius)
        i, j = np.nonzero(d2 <= r * r if inclusive else d2 < r * r)
        return pa.table([visitors[query_id].take(pa.array(columns[j])), home[point_id].take(pa.array(rows[i])), pa.array(d2[i, j])], names=[query_id, point_id, "d2"])

    schema = T.StructType([queries.schema[query_id], points.schema[point_id], T.StructField("d2", T.DoubleType())])
    return balls.meet(points.select(point_id, *AXES), queries.select(query_id, *AXES, *extra), radius, balls.pairs(pick, radius), schema)


def knn(points: DataFrame, queries: DataFrame, k: int, point_id: str = "point_id", query_id: str = "query_id") -> DataFrame:
    """(query_id, point_id, d2, rank): the k nearest points, ties by id, on a partition that follows the points' density. Points and queries with non-finite coordinates have no row."""
    return kd.knn(points.filter(finite(*AXES)), queries.filter(finite(*AXES)), k, point_id, query_id)


def capped_radius_join(points: DataFrame, queries: DataFrame, radius: float, most: int, point_id: str = "point_id", query_id: str = "query_id") -> DataFrame:
    """(query_id, point_id, d2, rank): at most `most` points with d2 < r2, nearest first, ties by id; no more of a ball's points are made into rows."""
    return kd.knn(points.filter(finite(*AXES)), queries.filter(finite(*AXES)), most, point_id, query_id, within=radius * radius)


def approximate_nearest(points: DataFrame, queries: DataFrame, size: float, point_id: str = "point_id", query_id: str = "query_id") -> DataFrame:
    """(query_id, point_id, d2): the nearest point in the query's own cell, or else near it in the octree.

    A query in an empty cell goes to the parents, cells twice as wide, up to the root: the
    first one that is not empty offers one point (that of least id) for each of its at most
    eight children (the root's are the cells -1 and 0 of each axis). So every finite query has a row if there is a finite point.
    """
    points, queries = points.filter(finite(*AXES)), queries.filter(finite(*AXES))
    cells = [cell(c, size).alias(f"c{c}") for c in AXES]
    held, left = points.select(point_id, *AXES, *cells), cut(queries.select(query_id, *(F.col(c).alias(f"q{c}") for c in AXES), *cells))
    d2 = sum((F.col(c) - F.col(f"q{c}")) * (F.col(c) - F.col(f"q{c}")) for c in AXES)
    key, done = ["cx", "cy", "cz"], None

    def best(both: DataFrame) -> DataFrame:
        nearest = both.groupBy(query_id).agg(F.min(F.struct(d2.alias("d2"), F.col(point_id).alias("point"))).alias("best"))
        return cut(nearest.select(query_id, F.col("best.point").alias(point_id), F.col("best.d2").alias("d2")))

    def up(df: DataFrame) -> DataFrame:
        return df.withColumns({c: F.floor(F.col(c) / 2).cast("long") for c in key})

    part = _in_own_cell(held, left, point_id, query_id)
    while True:
        done = part if done is None else done.unionByName(part)
        left = cut(left.hint("merge").join(part, query_id, "left_anti"))
        if left.isEmpty() or held.isEmpty():
            return done
        held = cut(held.groupBy(*key).agg(F.min(F.struct(point_id, *AXES)).alias("p")).select("p.*", *key))
        if held.filter(" OR ".join(f"{c} NOT IN (-1, 0)" for c in key)).isEmpty():
            # The root: its children never merge; they offer a point each to the queries outside.
            return done.unionByName(best(left.crossJoin(F.broadcast(held.select(point_id, *AXES)))))
        held, left = up(held), up(left)
        part = best(left.hint("merge").join(held, key))


def _in_own_cell(held: DataFrame, asked: DataFrame, point_id: str, query_id: str) -> DataFrame:
    """(query_id, point_id, d2): the nearest point in the query's cell, ties by id. Cells are dealt in pieces of at most HELD points, and each piece searches
    its points for the queries by buckets, so a pair is no row; a query sends a row for each piece of its cell."""
    key = ["cx", "cy", "cz"]
    points = held.join(asked.select(*key).distinct().hint("merge"), key, "left_semi")
    parts = points.groupBy(*key).agg(F.ceil(F.count(F.lit(1)) / HELD).cast("int").alias("parts"))
    p = points.join(parts.hint("merge"), key).select(*key, F.pmod(F.xxhash64(point_id), "parts").cast("int").alias("part"), F.lit(0).alias("side"), F.col(point_id).alias("p"), *AXES)
    q = asked.join(parts.hint("merge"), key).select(*key, F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(1).alias("side"), F.col(query_id).alias("q"), *(F.col(f"q{c}").alias(c) for c in AXES))
    schema = T.StructType([T.StructField(query_id, asked.schema[query_id].dataType), T.StructField(point_id, held.schema[point_id].dataType), T.StructField("d2", T.DoubleType())])
    group = [*key, "part"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows are sorted by cell and piece, points first; pieces end within batches and go on in the next ones."""
        here, kept, ready = None, [], None

        def found(some: pa.Table, there: tuple) -> pa.RecordBatch:
            ids, x = there
            row, d2, _ = kd.search(x, balls.xyz(some), 1, np.full(some.num_rows, np.inf))
            return pa.RecordBatch.from_arrays([some["q"].combine_chunks(), ids.take(pa.array(row[:, 0])), pa.array(d2[:, 0])], names=schema.names)

        for b in batches:
            if not b.num_rows:
                continue
            at = np.stack([b.column(c).to_numpy() for c in (*group, "side")], axis=1)
            ends = np.append(np.flatnonzero((at[1:] != at[:-1]).any(axis=1)) + 1, len(at))
            begin = 0
            for end in ends.tolist():
                some, own, side = pa.Table.from_batches([b.slice(begin, end - begin)]), tuple(at[begin, :4].tolist()), at[begin, 4]
                begin = end
                if own != here:
                    here, kept, ready = own, [], None
                if not side:
                    kept.append(some)
                    continue
                if ready is None and kept:
                    t = pa.concat_tables(kept).select(["p", *AXES]).sort_by("p").combine_chunks()
                    ready, kept = (t["p"].combine_chunks(), balls.xyz(t)), []
                if ready is not None:
                    yield found(some, ready)

    both = p.unionByName(q, allowMissingColumns=True)
    spark = held.sparkSession
    # These rows are few bytes but much work, so their tasks aren't left to sizes.
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 8 * spark.sparkContext.defaultParallelism)
    near = both.repartition(tasks, *group).sortWithinPartitions(*group, "side").mapInArrow(run, schema)
    nearest = near.groupBy(query_id).agg(F.min(F.struct("d2", F.col(point_id).alias("point"))).alias("best"))
    return cut(nearest.select(query_id, F.col("best.point").alias(point_id), F.col("best.d2").alias("d2")))


def nearest_in_cone(points: DataFrame, queries: DataFrame, radius: float, axis: tuple[float, float, float], cosine: float, point_id: str = "point_id", query_id: str = "query_id") -> DataFrame:
    """(query_id, point_id, d2): the nearest point within the radius whose direction from the query is within the cone around the unit axis. Tasks keep a query's best point and look no farther than it."""

    def fits(q: np.ndarray, p: np.ndarray, d2: np.ndarray) -> np.ndarray:
        along = sum((p[None, :, i] - q[:, i, None]) * a for i, a in enumerate(axis))
        return (d2 > 0) & (along >= cosine * np.sqrt(d2))

    schema = T.StructType([queries.schema[query_id], points.schema[point_id], T.StructField("d2", T.DoubleType())])
    return balls.meet(queries.select(query_id, *AXES), points.select(point_id, *AXES), radius, balls.nearest(radius, fits, query_id, point_id), schema)


def farther_than(source: DataFrame, target: DataFrame, squared: float, point_id: str = "point_id") -> DataFrame:
    """Source points whose nearest target point has a squared distance over the threshold."""
    q = source.withColumnRenamed(point_id, "query_id")
    close = radius_join(target, q, squared**0.5 or 1e-9, inclusive=True, point_id=point_id).select(F.col("query_id").alias(point_id)).distinct()
    return source.join(close, point_id, "left_anti")


def mean_distance(points: DataFrame, k: int, point_id: str = "point_id") -> DataFrame:
    """(point_id, mean): mean distance of each point's k nearest others."""
    q = points.withColumnRenamed(point_id, "query_id")
    near = knn(points, q, k + 1, point_id=point_id).filter(F.col("query_id") != F.col(point_id))
    w = Window.partitionBy("query_id").orderBy("d2", point_id)
    near = near.withColumn("r", F.row_number().over(w)).filter(F.col("r") <= k)
    return near.groupBy(F.col("query_id").alias(point_id)).agg((F.sum(F.sqrt("d2")) / k).alias("mean"))


def statistical_inliers(points: DataFrame, k: int, factor: float, point_id: str = "point_id") -> DataFrame:
    """Points whose mean neighbour distance is at most mean + factor * standard deviation over all points. Non-finite points count nowhere and stay."""
    whole = points.filter(finite(*AXES))
    means = cut(mean_distance(whole, k, point_id))
    stats = means.agg(F.avg("mean").alias("m"), F.stddev_samp("mean").alias("s"))
    keep = means.join(F.broadcast(stats), F.col("mean") <= F.col("m") + factor * F.coalesce("s", F.lit(0.0))).select(point_id)
    return whole.join(keep, point_id, "left_semi").unionByName(points.filter(~finite(*AXES)))


def radius_inliers(points: DataFrame, radius: float, least: int, negative: bool = False, point_id: str = "point_id") -> DataFrame:
    """Points with more than `least` points within the radius (inclusive), themselves among them; negative inverts. A point's count stops when it is enough."""

    def run(home: pa.Table, batches: Iterator[pa.Table]) -> Iterator[pa.Table]:
        mine, n, done = balls.Buckets(balls.xyz(home), 4 * radius), np.zeros(home.num_rows, np.int64), np.zeros(home.num_rows, bool)
        for visitors in batches:
            for rows, _, d2 in balls.met(mine, balls.Buckets(balls.xyz(visitors), 4 * radius), radius * radius, done):
                n[rows] += np.count_nonzero(d2 <= radius * radius, axis=1)
                done[rows] = n[rows] > least
        yield home.filter(pa.array(n > least)).select([point_id])

    p = points.select(point_id, *AXES)
    enough = balls.meet(p, p, radius, run, T.StructType([points.schema[point_id]]))
    return points.join(enough.hint("merge"), point_id, "left_anti" if negative else "left_semi")
