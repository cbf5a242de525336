"""Clustering of vectors around centroids by equal-average equal-variance search.

Components are scaled and floored to whole numbers, so distances and means are exact and
the result doesn't depend on how rows are dealt. For any vectors x, c of d components with
sums S and deviations V = sqrt(sum (x_i - S / d)^2):

    |x - c|^2 >= (S_x - S_c)^2 / d + (V_x - V_c)^2

Centroids are sorted by their mean. A vector begins at its own mean and looks outward, always
at the side whose next centroid is nearer in mean: once the first term alone exceeds
the best distance so far, all that is left on both sides is farther; a centroid whose two
terms exceed it is passed over; the others are compared by whole numbers. Equal distances go
to the smaller number. Bounds are floating point with a margin far over their error, so
they never reject a centroid that is as near as the best.

A round is one pass over the vectors; tasks send the sums of their clusters (k rows), so
what reaches the driver are k * d sums whatever the number of vectors.

Defined results: rows whose vector is null, has another number of components or a
component that is null or not finite are left out; a scaled component of 2^27 or more can't be
squared and summed in 64 bits and is refused with an error, inertia beyond 64 bits is null; rows
of one id are vectors of their own and rank by their components where their hashes tie; rows
without id are clustered and become first centroids after all others; with fewer vectors
than k all of them are centroids; an empty table gives an empty table; extra columns,
whatever their names, are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from geomill.llm.text import thrifty
from geomill.llm.workspace import written

DIMS, SCALE, CLUSTERS, ROUNDS = 64, 64, 16, 3
LARGEST = 1 << 27
#: Vectors compared at once in a task.
BLOCK = 4096


def whole(column: pa.Array, dims: int = DIMS, scale: int = SCALE) -> tuple[np.ndarray, np.ndarray]:
    """Rows of a list column that count, and their components as whole numbers."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    fit = np.flatnonzero(pc.fill_null(pc.equal(pc.list_value_length(column), dims), False).to_numpy(zero_copy_only=False))
    flat = column.take(pa.array(fit)).flatten()
    x = flat.cast(pa.float64()).to_numpy(zero_copy_only=False).reshape(-1, dims)  # null becomes NaN
    good = np.isfinite(x).all(axis=1)
    q = np.floor(scale * x[good])
    if q.size and np.abs(q).max() >= LARGEST:
        raise ValueError(f"a component times {scale} is {LARGEST} or more")
    return fit[good], q.astype(np.int64)


@dataclass
class Centroids:
    """Centroids sorted by mean: their numbers, components, sums and deviations."""

    number: np.ndarray
    parts: np.ndarray
    sums: np.ndarray
    spread: np.ndarray


def by_mean(parts: np.ndarray) -> Centroids:
    """parts: components of the centroids 0, 1, ..."""
    sums = parts.sum(axis=1)
    order = np.argsort(sums, kind="stable")
    return Centroids(order, parts[order], sums[order], _spread(parts[order]))


def _spread(q: np.ndarray) -> np.ndarray:
    return np.sqrt(((q - q.mean(axis=1, keepdims=True)) ** 2).sum(axis=1))


def nearest(q: np.ndarray, c: Centroids) -> tuple[np.ndarray, np.ndarray, int]:
    """Number of the nearest centroid and squared distance for each vector, and how many distances were computed."""
    n, d = q.shape
    k = len(c.number)
    sums, spread = q.sum(axis=1), _spread(q)
    best, number = np.full(n, np.iinfo(np.int64).max), np.full(n, k)
    high = np.searchsorted(c.sums, sums)
    low = high - 1
    active, computed = np.arange(n), 0
    far = np.iinfo(np.int64).max
    while len(active):
        lo, hi = low[active], high[active]
        down = np.where(lo >= 0, sums[active] - c.sums[np.maximum(lo, 0)], far)
        up = np.where(hi < k, c.sums[np.minimum(hi, k - 1)] - sums[active], far)
        under = down <= up
        gap = np.minimum(down, up)
        at = np.clip(np.where(under, lo, hi), 0, k - 1)
        mean = gap.astype(np.float64) ** 2 / d
        limit = best[active] + 1e-9 * (best[active] + spread[active] ** 2 + c.spread[at] ** 2 + 1.0)
        go = (gap < far) & (mean <= limit)
        active, at, under = active[go], at[go], under[go]
        low[active] -= under
        high[active] += ~under
        close = mean[go] + (spread[active] - c.spread[at]) ** 2 <= limit[go]
        row, at = active[close], at[close]
        computed += len(row)
        diff = q[row] - c.parts[at]
        dist = np.einsum("ij,ij->i", diff, diff)
        better = (dist < best[row]) | ((dist == best[row]) & (c.number[at] < number[row]))
        best[row[better]], number[row[better]] = dist[better], c.number[at[better]]
    return number, best, computed


def first_centroids(vectors: DataFrame, k: int = CLUSTERS, vec_id: str = "vec_id", column: str = "embedding", dims: int = DIMS, scale: int = SCALE) -> np.ndarray:
    """The k vectors with the least SHA-256 of `1:<id>`, in that order; each task sends k at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for batch in batches:
            rows, q = whole(batch.column(1), dims, scale)
            names = [batch.column(0)[i].as_py() for i in rows.tolist()]
            hashes = [(i is None, "" if i is None else hashlib.sha256(f"1:{i}".encode()).hexdigest()) for i in names]
            order = sorted(range(len(rows)), key=hashes.__getitem__)
            if len(order) > k:
                order = [i for i in order if hashes[i] <= hashes[order[k - 1]]]
            held = sorted(held + [(*hashes[i], q[i].tolist()) for i in order])[:k]
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*held), (pa.bool_(), pa.string(), pa.list_(pa.int64())))], names=["nameless", "hash", "parts"])

    few = vectors.select(F.col(vec_id).cast("string"), column).mapInArrow(thrifty(run), "nameless boolean, hash string, parts array<long>")
    rows = few.orderBy("nameless", "hash", "parts").limit(k).collect()
    return np.array([r["parts"] for r in rows], np.int64).reshape(-1, dims)


def assigned(vectors: DataFrame, centroids: np.ndarray, vec_id: str = "vec_id", column: str = "embedding", scale: int = SCALE) -> DataFrame:
    """(id, cluster, distance) of each vector that counts."""
    c, dims = by_mean(centroids), centroids.shape[1]
    schema = T.StructType([T.StructField(vec_id, vectors.schema[vec_id].dataType), T.StructField("cluster", T.IntegerType()), T.StructField("distance", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, BLOCK):
                part = batch.slice(i, BLOCK)
                rows, q = whole(part.column(1), dims, scale)
                number, dist, _ = nearest(q, c)
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(rows)), pa.array(number, pa.int32()), pa.array(dist, pa.int64())], names=schema.names)

    return vectors.select(vec_id, column).mapInArrow(thrifty(run), schema)


def moved(vectors: DataFrame, centroids: np.ndarray, column: str = "embedding", scale: int = SCALE) -> np.ndarray:
    """Centroids after one round: the floor of each cluster's mean; an empty one stays."""
    c, (k, dims) = by_mean(centroids), centroids.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, total = np.zeros(k, np.int64), np.zeros((k, dims), np.int64)
        for batch in batches:
            for i in range(0, batch.num_rows, BLOCK):
                _, q = whole(batch.slice(i, BLOCK).column(0), dims, scale)
                number = nearest(q, c)[0]
                count += np.bincount(number, minlength=k)
                np.add.at(total, number, q)
        some = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(count[some]), pa.array(total[some].tolist(), pa.list_(pa.int64()))], names=["cluster", "n", "sums"])

    sums = vectors.select(column).mapInArrow(thrifty(run), "cluster int, n long, sums array<long>").select("cluster", "n", F.posexplode("sums").alias("at", "s"))
    exact = lambda c: F.sum(F.col(c).cast("decimal(38,0)"))
    out = centroids.copy()
    for r in sums.groupBy("cluster", "at").agg(exact("n").alias("n"), exact("s").alias("s")).collect():
        out[r["cluster"], r["at"]] = int(r["s"]) // int(r["n"])
    return out


def clusters(vectors: DataFrame, k: int = CLUSTERS, rounds: int = ROUNDS, vec_id: str = "vec_id", column: str = "embedding", dims: int = DIMS, scale: int = SCALE) -> tuple[DataFrame, np.ndarray]:
    """(id, cluster, distance) of each vector after so many rounds, and the centroids."""
    centroids = first_centroids(vectors, k, vec_id, column, dims, scale)
    if len(centroids):
        for _ in range(rounds):
            centroids = moved(vectors, centroids, column, scale)
        return assigned(vectors, centroids, vec_id, column, scale), centroids
    return vectors.select(vec_id, F.lit(None).cast("int").alias("cluster"), F.lit(None).cast("long").alias("distance")).limit(0), centroids


def summary(found: DataFrame, centroids: np.ndarray) -> DataFrame:
    """Each vector with its cluster's and the whole inertia and the digest of its centroid. One row a cluster is broadcast."""
    found = written(found)
    sums = {r["cluster"]: int(r["s"]) for r in found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()}
    fits = lambda v: v if v < 1 << 63 else None
    rows = [(c, fits(s), fits(sum(sums.values())), hashlib.sha256(",".join(map(str, centroids[c].tolist())).encode()).hexdigest()) for c, s in sums.items()]
    each = found.sparkSession.createDataFrame(rows, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return found.join(F.broadcast(each), "cluster")


def _round(i: int) -> str:
    """Assignment to the centroids c{i} and the centroids that follow."""
    return f"""
a{i} AS MATERIALIZED (
  SELECT r, min({{'d': d, 'c': c}}) AS best FROM (SELECT r, c, list_sum(list_transform(list_zip(kept.q, c{i}.q), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::BIGINT AS d FROM kept, c{i}) GROUP BY r
), c{i + 1} AS MATERIALIZED (
  SELECT c, coalesce(m.q, c{i}.q) AS q FROM c{i} LEFT JOIN (
    SELECT c, list((s - ((s % n) + n) % n) // n ORDER BY place) AS q
    FROM (SELECT c, place, sum(v)::BIGINT AS s, count(*) AS n FROM (SELECT best.c AS c, unnest(q) AS v, generate_subscripts(q, 1) AS place FROM a{i} JOIN kept USING (r)) GROUP BY c, place) GROUP BY c
  ) m USING (c)
)"""


#: The same result in SQL, with every distance computed.
ORACLE_SQL = f"""
WITH kept AS MATERIALIZED (
  SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)::BIGINT) AS q
  FROM embeddings WHERE len(embedding) = {DIMS} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), c0 AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY h, q) - 1 AS c, q FROM (SELECT sha256('1:' || vec_id) AS h, q FROM kept ORDER BY h, q LIMIT {CLUSTERS})
),{",".join(_round(i) for i in range(ROUNDS + 1))}
SELECT vec_id, best.c::INT AS cluster, best.d AS distance, sum(best.d) OVER (PARTITION BY best.c)::BIGINT AS cluster_inertia, sum(best.d) OVER ()::BIGINT AS inertia,
       sha256(array_to_string(c{ROUNDS}.q, ',')) AS centroid_sha256
FROM a{ROUNDS} JOIN kept USING (r) JOIN c{ROUNDS} ON c{ROUNDS}.c = best.c
"""
