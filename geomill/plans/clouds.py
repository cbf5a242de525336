"""Queries on point clouds."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from geomill.operators import features, filters, fit, neighbors, voxel
from geomill.plans.registry import Registry
from geomill.plans.tables import CLOUD, POINTS, QUERIES, cloud, points, queries

query = Registry()
D2 = "(p.x - q.x) * (p.x - q.x) + (p.y - q.y) * (p.y - q.y) + (p.z - q.z) * (p.z - q.z)"
PAIRS = f"WITH {POINTS}, {QUERIES}, pairs AS (SELECT query_id, radius, point_id, p.x AS px, p.y AS py, p.z AS pz, q.x AS qx, q.y AS qy, q.z AS qz, {D2} AS d2 FROM points p, queries q)"
SELF = f"WITH {CLOUD}, pairs AS (SELECT q.point_id AS query_id, p.point_id, {D2} AS d2, p.x AS px, p.y AS py, p.z AS pz, p.v AS pv, q.v AS qv FROM cloud p, cloud q)"


@query(f"WITH {POINTS} SELECT point_id, x, y, z FROM points WHERE v BETWEEN 500 AND 1500")
def pass_through(spark: SparkSession, d: str) -> DataFrame:
    return filters.pass_through(points(spark, d), "v", 500, 1500).select("point_id", "x", "y", "z")


@query(f"WITH {POINTS} SELECT point_id, x, y, z FROM points WHERE NOT (v BETWEEN 500 AND 1500)")
def pass_through_negative(spark: SparkSession, d: str) -> DataFrame:
    return filters.pass_through(points(spark, d), "v", 500, 1500, negative=True).select("point_id", "x", "y", "z")


@query(f"WITH {POINTS} SELECT point_id FROM points WHERE (x > 100 AND z <= 500) OR (v >= 4000 AND y < 300)")
def conditional_removal(spark: SparkSession, d: str) -> DataFrame:
    tree = ("or", ("and", ("x", "GT", 100), ("z", "LE", 500)), ("and", ("v", "GE", 4000), ("y", "LT", 300)))
    return points(spark, d).filter(filters.condition(tree)).select("point_id")


BOX = dict(low=(-200, -100, 0), high=(200, 100, 600), rotation=[[0.6, -0.8, 0], [0.8, 0.6, 0], [0, 0, 1]], shift=(500, 500, 100))
INSIDE = "(0.6 * (x - 500) + 0.8 * (y - 500)) BETWEEN -200 AND 200 AND (-0.8 * (x - 500) + 0.6 * (y - 500)) BETWEEN -100 AND 100 AND z - 100 BETWEEN 0 AND 600"


@query(f"WITH {POINTS} SELECT point_id FROM points WHERE {INSIDE}")
def crop_box(spark: SparkSession, d: str) -> DataFrame:
    return filters.crop_box(points(spark, d), **BOX).select("point_id")


@query(f"WITH {POINTS} SELECT point_id FROM points WHERE NOT ({INSIDE})")
def crop_box_negative(spark: SparkSession, d: str) -> DataFrame:
    return filters.crop_box(points(spark, d), **BOX, negative=True).select("point_id")


@query(f"WITH {POINTS} SELECT point_id FROM points WHERE x + y - 1200 <= 0 AND -x + 100 <= 0 AND z - 2 * y <= 0")
def frustum_culling(spark: SparkSession, d: str) -> DataFrame:
    return filters.half_spaces(points(spark, d), [(1, 1, 0, -1200), (-1, 0, 0, 100), (0, -2, 1, 0)]).select("point_id")


@query(f"WITH {POINTS} SELECT point_id FROM points WHERE y >= 100 AND y < 500 AND x < 900 AND x >= 100 AND x < 900 - (y - 100) * 2 + 0")
def crop_hull_2d(spark: SparkSession, d: str) -> DataFrame:
    return filters.in_polygon(points(spark, d), [(100, 100), (900, 100), (100, 500)]).select("point_id")


@query(f"WITH {POINTS} SELECT point_id, round(2 * y + 10, 4) AS x, round(-x + 5, 4) AS y, round(0.5 * z - 1, 4) AS z FROM points")
def affine_transform(spark: SparkSession, d: str) -> DataFrame:
    out = filters.transformed(points(spark, d), [[0, 2, 0, 10], [-1, 0, 0, 5], [0, 0, 0.5, -1]])
    return out.select("point_id", *(F.round(c, 4).alias(c) for c in "xyz"))


def _indices(spark: SparkSession, d: str) -> DataFrame:
    o = spark.read.parquet(f"{d}/lineitem.parquet")
    return o.filter("l_quantity > 45").groupBy(F.col("l_orderkey").alias("point_id"), "l_linenumber", "l_partkey").agg(F.count(F.lit(1)).alias("ordinal")).select("ordinal", "point_id")


LISTED = "listed AS (SELECT count(*) AS ordinal, l_orderkey AS point_id FROM lineitem WHERE l_quantity > 45 GROUP BY l_orderkey, l_linenumber, l_partkey)"


@query(f"WITH {POINTS}, {LISTED} SELECT ordinal, point_id, x, y, z FROM listed JOIN points USING (point_id)")
def extract_indices(spark: SparkSession, d: str) -> DataFrame:
    return filters.take_indices(points(spark, d), _indices(spark, d)).select("ordinal", "point_id", "x", "y", "z")


@query(f"WITH {POINTS}, {LISTED} SELECT point_id FROM points WHERE point_id NOT IN (SELECT point_id FROM listed)")
def extract_indices_negative(spark: SparkSession, d: str) -> DataFrame:
    return filters.take_indices(points(spark, d), _indices(spark, d), negative=True).select("point_id")


RGB = "rgb AS (SELECT p_partkey AS point_id, (p_partkey * 2654435) % 16777216 AS rgb FROM part), s AS (SELECT point_id, rgb & 255 AS r, (rgb >> 8) & 255 AS g, (rgb >> 16) & 255 AS b FROM rgb)"


@query(f"WITH {RGB} SELECT point_id, r, g, b, round(CASE WHEN r + g + b > 0 THEN 1 - 3.0 * least(r, g, b) / (r + g + b) ELSE 0 END, 4) AS saturation, round((r + g + b) / 3.0, 4) AS intensity FROM s WHERE r > 128 AND g <= 200")
def packed_rgb(spark: SparkSession, d: str) -> DataFrame:
    p = spark.read.parquet(f"{d}/part.parquet").select(F.col("p_partkey").alias("point_id"), ((F.col("p_partkey") * 2654435) % 16777216).alias("rgb"))
    out = filters.change_packed_rgb(p).filter("r > 128 AND g <= 200")
    return out.select("point_id", "r", "g", "b", F.round("saturation", 4).alias("saturation"), F.round("intensity", 4).alias("intensity"))


@query(f"{PAIRS} SELECT query_id, point_id, d2 FROM pairs WHERE d2 < 50 * 50")
def radius_search(spark: SparkSession, d: str) -> DataFrame:
    return neighbors.radius_join(points(spark, d), queries(spark, d), 50)


@query(f"{PAIRS} SELECT query_id, point_id, d2 FROM pairs WHERE d2 < radius * radius")
def radius_search_own_radii(spark: SparkSession, d: str) -> DataFrame:
    return neighbors.radius_join(points(spark, d), queries(spark, d), 50, per_query="radius")


@query(f"{PAIRS} SELECT query_id, point_id, d2 FROM pairs WHERE d2 < 50 * 50 AND query_id % 2 = 0")
def radius_search_subset(spark: SparkSession, d: str) -> DataFrame:
    return neighbors.radius_join(points(spark, d), queries(spark, d).filter("query_id % 2 = 0"), 50)


@query(f"{PAIRS} SELECT query_id, point_id, d2 FROM pairs WHERE d2 < 60 * 60 QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY d2, point_id) <= 3")
def radius_search_capped(spark: SparkSession, d: str) -> DataFrame:
    return neighbors.capped_radius_join(points(spark, d), queries(spark, d), 60, 3).select("query_id", "point_id", "d2")


@query(f"{PAIRS} SELECT query_id, point_id, d2 FROM pairs QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY d2, point_id) = 1")
def nearest_neighbour(spark: SparkSession, d: str) -> DataFrame:
    return neighbors.knn(points(spark, d), queries(spark, d), 1).select("query_id", "point_id", "d2")


@query(f"{PAIRS}, r AS (SELECT query_id, point_id, d2, row_number() OVER (PARTITION BY query_id ORDER BY d2, point_id) AS rank FROM pairs) SELECT query_id, point_id, d2, rank FROM r WHERE rank <= 5")
def knn_search(spark: SparkSession, d: str) -> DataFrame:
    return neighbors.knn(points(spark, d), queries(spark, d), 5).select("query_id", "point_id", "d2", F.col("rank").cast("long").alias("rank"))


def _level(n: int) -> str:
    """Queries against the points that level n of the octree offers: all of their cell, or the first of each child cell."""
    cells = lambda t, size: ", ".join(f"floor({t}.{c} / {size})" for c in "xyz")
    offered = "points" if not n else f"(SELECT p.* FROM points p QUALIFY row_number() OVER (PARTITION BY {cells('p', 50 << n)} ORDER BY point_id) = 1)"
    return f"SELECT {n} AS level, query_id, p.point_id, (p.x - q.x) * (p.x - q.x) + (p.y - q.y) * (p.y - q.y) + (p.z - q.z) * (p.z - q.z) AS d2 FROM queries q JOIN {offered} p ON ({cells('p', 100 << n)}) = ({cells('q', 100 << n)})"


@query(f"WITH {POINTS}, {QUERIES}, c AS ({' UNION ALL '.join(map(_level, range(5)))}) SELECT query_id, point_id, d2 FROM c QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY level, d2, point_id) = 1")
def approximate_nearest(spark: SparkSession, d: str) -> DataFrame:
    return neighbors.approximate_nearest(points(spark, d), queries(spark, d), 100)


@query(f"{PAIRS}, c AS (SELECT query_id, point_id, d2 FROM pairs WHERE d2 < 80 * 80 AND d2 > 0 AND (pz - qz) >= 0.5 * sqrt(d2)) SELECT query_id, point_id, d2 FROM c QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY d2, point_id) = 1")
def nearest_in_cone(spark: SparkSession, d: str) -> DataFrame:
    return neighbors.nearest_in_cone(points(spark, d), queries(spark, d), 80, (0, 0, 1), 0.5)


@query(f"{PAIRS} SELECT query_id AS point_id FROM queries WHERE query_id NOT IN (SELECT query_id FROM pairs WHERE d2 <= 900)")
def segment_difference(spark: SparkSession, d: str) -> DataFrame:
    return neighbors.farther_than(queries(spark, d).withColumnRenamed("query_id", "point_id"), points(spark, d), 900).select("point_id")


MEANS = f"{SELF}, near AS (SELECT query_id, d2 FROM pairs WHERE query_id <> point_id QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY d2, point_id) <= 4), means AS (SELECT query_id AS point_id, sum(sqrt(d2)) / 4 AS m FROM near GROUP BY 1)"


@query(f"{MEANS} SELECT point_id, round(m, 4) AS mean FROM means")
def mean_neighbour_distance(spark: SparkSession, d: str) -> DataFrame:
    return neighbors.mean_distance(cloud(spark, d), 4).select("point_id", F.round("mean", 4).alias("mean"))


@query(f"{MEANS} SELECT point_id FROM means WHERE m <= (SELECT avg(m) + 1.0 * stddev_samp(m) FROM means)")
def statistical_outlier_removal(spark: SparkSession, d: str) -> DataFrame:
    return neighbors.statistical_inliers(cloud(spark, d), 4, 1.0).select("point_id")


GAPS = f"WITH {CLOUD}, gaps AS (SELECT point_id, CASE WHEN point_id % 40 = 7 THEN 'nan'::DOUBLE WHEN point_id % 40 = 9 THEN 'inf'::DOUBLE ELSE x END AS x, y, z FROM cloud), whole AS (SELECT * FROM gaps WHERE isfinite(x)), near AS (SELECT q.point_id AS query_id, (p.x - q.x) * (p.x - q.x) + (p.y - q.y) * (p.y - q.y) + (p.z - q.z) * (p.z - q.z) AS d2 FROM whole p, whole q WHERE p.point_id <> q.point_id QUALIFY row_number() OVER (PARTITION BY q.point_id ORDER BY d2, p.point_id) <= 4), means AS (SELECT query_id AS point_id, sum(sqrt(d2)) / 4 AS m FROM near GROUP BY 1)"


@query(f"{GAPS} SELECT point_id FROM means WHERE m <= (SELECT avg(m) + 1.0 * stddev_samp(m) FROM means) UNION ALL SELECT point_id FROM gaps WHERE NOT isfinite(x)")
def outlier_removal_with_gaps(spark: SparkSession, d: str) -> DataFrame:
    """Scans have points without a finite place; they count nowhere and stay."""
    x = F.when(F.col("point_id") % 40 == 7, F.lit(float("nan"))).when(F.col("point_id") % 40 == 9, F.lit(float("inf"))).otherwise(F.col("x"))
    return neighbors.statistical_inliers(cloud(spark, d).withColumn("x", x), 4, 1.0).select("point_id")


@query(f"{SELF} SELECT query_id AS point_id FROM pairs WHERE d2 <= 900 GROUP BY 1 HAVING count(*) > 2")
def radius_outlier_removal(spark: SparkSession, d: str) -> DataFrame:
    return neighbors.radius_inliers(cloud(spark, d), 30, 2).select("point_id")


@query(f"WITH {POINTS} SELECT floor(x / 100)::BIGINT AS cx, floor(y / 100)::BIGINT AS cy, floor(z / 100)::BIGINT AS cz, count(*) AS n, round(avg(x), 4) AS x, round(avg(y), 4) AS y, round(avg(z), 4) AS z FROM points GROUP BY 1, 2, 3 HAVING count(*) >= 5")
def voxel_grid(spark: SparkSession, d: str) -> DataFrame:
    return voxel.voxel_grid(points(spark, d), 100, 5).select("cx", "cy", "cz", "n", *(F.round(c, 4).alias(c) for c in "xyz"))


@query(f"WITH {POINTS} SELECT floor(x / 200)::BIGINT AS cx, floor(y / 200)::BIGINT AS cy, floor(z / 200)::BIGINT AS cz, count(*) AS n, {", ".join(f"round(covar_samp({a}, {b}) * count(*) * (count(*) - 1)) AS scatter_{a}{b}" for a, b in ("xx", "xy", "xz", "yy", "yz", "zz"))} FROM points GROUP BY 1, 2, 3 HAVING count(*) >= 6")
def voxel_covariance(spark: SparkSession, d: str) -> DataFrame:
    # Of whole coordinates n (n - 1) times the covariance is a whole number, which both engines round to alike.
    return voxel.voxel_covariance(points(spark, d), 200).select("cx", "cy", "cz", "n", *(F.round(F.col(f"cov_{c}") * F.col("n") * (F.col("n") - 1)).alias(f"scatter_{c}") for c in ("xx", "xy", "xz", "yy", "yz", "zz")))


@query(f"WITH {POINTS}, c AS (SELECT floor(x / 200)::BIGINT AS cx, floor(y / 200)::BIGINT AS cy, floor(z / 200)::BIGINT AS cz, v::BIGINT % 5 AS label, count(*) AS votes FROM points GROUP BY ALL), t AS (SELECT *, sum(votes) OVER (PARTITION BY cx, cy, cz) AS n, row_number() OVER (PARTITION BY cx, cy, cz ORDER BY votes DESC, label) AS r FROM c) SELECT cx, cy, cz, n::BIGINT AS n, label, votes FROM t WHERE r = 1")
def label_vote(spark: SparkSession, d: str) -> DataFrame:
    return voxel.label_vote(points(spark, d).withColumn("label", F.col("v").cast("long") % 5), 200, "label")


@query(f"WITH {POINTS} SELECT floor(x / 50)::BIGINT AS cx, floor(y / 50)::BIGINT AS cy, point_id, x, y, z FROM points QUALIFY row_number() OVER (PARTITION BY floor(x / 50), floor(y / 50) ORDER BY z, point_id) = 1")
def grid_minimum(spark: SparkSession, d: str) -> DataFrame:
    return voxel.grid_minimum(points(spark, d), 50)


@query(f"WITH {POINTS} SELECT min(x) AS min_x, max(x) AS max_x, min(y) AS min_y, max(y) AS max_y, min(z) AS min_z, max(z) AS max_z FROM points")
def bounding_box(spark: SparkSession, d: str) -> DataFrame:
    return voxel.bounding_box(points(spark, d))


@query(f"WITH {POINTS} SELECT count(*) AS n, round(avg(v), 4) AS mean, round(stddev_samp(v), 4) AS std FROM points")
def mean_std(spark: SparkSession, d: str) -> DataFrame:
    return points(spark, d).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("v"), 4).alias("mean"), F.round(F.stddev_samp("v"), 4).alias("std"))


@query(f"WITH {CLOUD} SELECT count(*) AS n, round(avg(x), 4) AS mean_x, round(avg(y), 4) AS mean_y, round(avg(z), 4) AS mean_z, round(covar_pop(x, x), 3) AS cov_xx, round(covar_pop(x, y), 3) AS cov_xy, round(covar_pop(x, z), 3) AS cov_xz, round(covar_pop(y, y), 3) AS cov_yy, round(covar_pop(y, z), 3) AS cov_yz, round(covar_pop(z, z), 3) AS cov_zz FROM cloud")
def mean_and_covariance(spark: SparkSession, d: str) -> DataFrame:
    m = fit.moments(cloud(spark, d))
    return m.select("n", *(F.round(c, 4).alias(c) for c in ("mean_x", "mean_y", "mean_z")), *(F.round(f"cov_{c}", 3).alias(f"cov_{c}") for c in ("xx", "xy", "xz", "yy", "yz", "zz")))


@query()
def principal_alignment(spark: SparkSession, d: str) -> DataFrame:
    return fit.aligned(cloud(spark, d), points(spark, d)).select("point_id", "x", "y", "z")


@query()
def fitted_sphere(spark: SparkSession, d: str) -> DataFrame:
    return fit.fitted_sphere(points(spark, d))


PLANES = [(0, 0.6, 0.8, 0.0, -700.0), (1, 0.0, 0.0, 1.0, -500.0), (2, 0.0, 1.0, 0.0, -200.0), (3, 0.8, 0.0, 0.6, -600.0)]
PLANE_ROWS = "models AS (SELECT * FROM (VALUES " + ", ".join(f"({m}, {a}::DOUBLE, {b}::DOUBLE, {c}::DOUBLE, {e}::DOUBLE)" for m, a, b, c, e in PLANES) + ") t(model_id, a, b, c, d))"
SCORED = f"WITH {POINTS}, {PLANE_ROWS}, r AS (SELECT model_id, abs(a * x + b * y + c * z + d) AS r FROM points, models)"


def _planes(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(PLANES, "model_id int, a double, b double, c double, d double")


@query(f"{SCORED} SELECT model_id, sum((r < 20.5)::INT)::BIGINT AS inliers, round(sum(least(r, 20.5)), 2) AS msac FROM r GROUP BY 1")
def plane_scores(spark: SparkSession, d: str) -> DataFrame:
    s = fit.score_models(points(spark, d), _planes(spark), fit.plane_residual(), 20.5)
    return s.select("model_id", "inliers", F.round("msac", 2).alias("msac"))


@query(f"{SCORED}, s AS (SELECT model_id, sum((r < 20.5)::INT)::BIGINT AS inliers FROM r GROUP BY 1) SELECT model_id, inliers FROM s ORDER BY inliers DESC, model_id LIMIT 1")
def ransac_best_plane(spark: SparkSession, d: str) -> DataFrame:
    return fit.best_model(fit.score_models(points(spark, d), _planes(spark), fit.plane_residual(), 20.5))


@query()
def ransac_sampled_planes(spark: SparkSession, d: str) -> DataFrame:
    p = points(spark, d)
    return fit.score_models(p, fit.planes_through(p, 32), fit.plane_residual(), 20.5)


@query(f"WITH RECURSIVE {CLOUD}, near AS (SELECT a.point_id AS a, b.point_id AS b FROM cloud a, cloud b WHERE (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) + (a.z - b.z) * (a.z - b.z) < 2025 AND a.point_id <> b.point_id), walk AS (SELECT point_id AS a, point_id AS c FROM cloud UNION SELECT near.b, walk.c FROM walk JOIN near ON walk.a = near.a), label AS (SELECT a AS point_id, min(c) AS cluster FROM walk GROUP BY 1), sized AS (SELECT *, count(*) OVER (PARTITION BY cluster) AS n FROM label) SELECT point_id, cluster, n FROM sized WHERE n >= 2")
def euclidean_clusters(spark: SparkSession, d: str) -> DataFrame:
    return features.clusters(cloud(spark, d), 45, least=2)


@query(f"WITH {CLOUD}, f AS (SELECT q.point_id, q.z, max(p.z) AS top FROM cloud q JOIN cloud p ON p.point_id <> q.point_id AND (p.x - q.x) * (p.x - q.x) + (p.y - q.y) * (p.y - q.y) < 400 GROUP BY 1, 2) SELECT point_id FROM f WHERE z > top")
def local_maxima(spark: SparkSession, d: str) -> DataFrame:
    return features.local_maxima(cloud(spark, d), 20).select("point_id")


@query(f"{SELF}, w AS (SELECT query_id, pv, exp(-d2 / 800.0) * exp(-(pv - qv) * (pv - qv) / 200.0) AS k FROM pairs WHERE d2 <= 1600) SELECT query_id AS point_id, round(sum(k * pv) / sum(k), 4) AS v FROM w GROUP BY 1")
def bilateral_filter(spark: SparkSession, d: str) -> DataFrame:
    return features.bilateral(cloud(spark, d), 20, 10).select("point_id", F.round("v", 4).alias("v"))


@query()
def normals_and_curvature(spark: SparkSession, d: str) -> DataFrame:
    return features.normals(cloud(spark, d), 40)


@query()
def difference_of_normals(spark: SparkSession, d: str) -> DataFrame:
    c = cloud(spark, d)
    return features.difference_of_normals(features.normals(c, 30), features.normals(c, 60))


@query()
def point_pair_features(spark: SparkSession, d: str) -> DataFrame:
    c = cloud(spark, d)
    return features.pair_features(c, features.normals(c, 60), 60)


@query()
def boundary_points(spark: SparkSession, d: str) -> DataFrame:
    return features.boundary_points(cloud(spark, d), 40, 2.0)


@query(f"WITH {POINTS}, o AS (SELECT *, lag(x) OVER w AS lx, lag(y) OVER w AS ly, lag(z) OVER w AS lz FROM (SELECT point_id, x, y, floor(z / 500) AS z FROM points) WINDOW w AS (ORDER BY x, y, z, point_id)) SELECT point_id FROM o WHERE NOT coalesce(abs(x - lx) <= 0.00001 AND abs(y - ly) <= 0.00001 AND abs(z - lz) <= 0.00001, false)")
def tolerant_dedupe(spark: SparkSession, d: str) -> DataFrame:
    p = points(spark, d).withColumn("z", F.floor(F.col("z") / 500).cast("double"))
    return filters.adjacent_dedupe(p, slab=10.0).select("point_id")


@query(f"WITH {POINTS}, {CLOUD} SELECT point_id, x, y, z FROM points UNION ALL SELECT point_id, x, y, z FROM cloud")
def append_clouds(spark: SparkSession, d: str) -> DataFrame:
    return points(spark, d).unionByName(cloud(spark, d)).select("point_id", "x", "y", "z")


SPREAD = " + ".join(f"(((floor({c})::BIGINT >> {b}) & 1) << {3 * b + i})" for b in range(10) for i, c in enumerate("xyz"))


@query(f"WITH {POINTS} SELECT point_id, ({SPREAD})::BIGINT AS morton FROM points")
def morton_keys(spark: SparkSession, d: str) -> DataFrame:
    return points(spark, d).select("point_id", voxel.morton(*(F.floor(c) for c in "xyz")).alias("morton"))


@query(f"WITH {POINTS}, m AS (SELECT point_id, ({SPREAD})::BIGINT AS morton FROM points) SELECT point_id, morton, row_number() OVER (PARTITION BY morton >> 18 ORDER BY morton, point_id) AS place FROM m")
def morton_order(spark: SparkSession, d: str) -> DataFrame:
    """Place of each point along the curve inside its octree cell of side 64."""
    key = voxel.morton(*(F.floor(c) for c in "xyz"))
    p = points(spark, d).select("point_id", key.alias("morton"))
    w = Window.partitionBy(F.shiftright("morton", 18)).orderBy("morton", "point_id")
    return p.withColumn("place", F.row_number().over(w).cast("long"))


@query(f"WITH {POINTS} SELECT ({SPREAD})::BIGINT >> 24 AS prefix, count(*) AS n, min(point_id) AS first_id FROM points GROUP BY 1")
def morton_octree_cells(spark: SparkSession, d: str) -> DataFrame:
    key = F.shiftright(voxel.morton(*(F.floor(c) for c in "xyz")), 24)
    return points(spark, d).groupBy(key.alias("prefix")).agg(F.count(F.lit(1)).alias("n"), F.min("point_id").alias("first_id"))


@query()
def random_subsample(spark: SparkSession, d: str) -> DataFrame:
    return filters.subsample(points(spark, d), 500, seed=3)
