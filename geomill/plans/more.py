"""Queries on rays, profiles, tiles, correspondences and images."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from geomill.operators import fit, neighbors, numbering, rays, stencil, surface, voxel
from geomill.plans.clouds import _planes, SCORED
from geomill.plans.registry import Registry
from geomill.plans.tables import CLOUD, DEPTH, HEIGHT, POINTS, QUERIES, VOLUME, WIDTH, cloud, depth, points, queries, table, volume
from geomill.plans.volumes import SOBEL, near_pixels

query = Registry()

SEGMENTS = DEPTH + ", rays AS (SELECT c_custkey AS ray_id, (c_custkey % 31) + 0.25 AS ax, (c_custkey * 7 % 31) + 0.5 AS ay, (c_custkey * 3 % greatest(depth - 1, 1)) + 0.125 AS az, (c_custkey * 11 % 31) + 0.75 AS bx, (c_custkey * 5 % 31) + 0.375 AS by_, (c_custkey * 2 % greatest(depth - 1, 1)) + 0.625 AS bz FROM customer, dims)"


def _segments(spark: SparkSession, d: str) -> DataFrame:
    k, far = F.col("c_custkey"), max(depth(spark, d) - 1, 1)
    return table(spark, d, "customer").select(k.alias("ray_id"), (k % 31 + 0.25).alias("ax"), (k * 7 % 31 + 0.5).alias("ay"), (k * 3 % far + 0.125).alias("az"), (k * 11 % 31 + 0.75).alias("bx"), (k * 5 % 31 + 0.375).alias("by"), (k * 2 % far + 0.625).alias("bz"))


CUTS = " UNION ".join(f"SELECT ray_id, (k - a{c})::DOUBLE / (b{e} - a{c}) AS t FROM rays, (SELECT unnest(range(0, depth + 40)) AS k FROM dims) WHERE k > least(a{c}, b{e}) AND k < greatest(a{c}, b{e})" for c, e in (("x", "x"), ("y", "y_"), ("z", "z")))
WALK = f"cuts AS ({CUTS} UNION SELECT ray_id, 0.0::DOUBLE FROM rays UNION SELECT ray_id, 1.0::DOUBLE FROM rays), mids AS (SELECT ray_id, t, (t + lead(t) OVER (PARTITION BY ray_id ORDER BY t)) / 2 AS m FROM cuts), walk AS (SELECT ray_id, (row_number() OVER (PARTITION BY ray_id ORDER BY m) - 1)::INT AS nth, floor(ax + m * (bx - ax))::INT AS x, floor(ay + m * (by_ - ay))::INT AS y, floor(az + m * (bz - az))::INT AS z FROM mids JOIN rays USING (ray_id) WHERE m IS NOT NULL)"


@query(f"WITH {SEGMENTS}, {WALK} SELECT ray_id, count(*) AS steps, count(DISTINCT (x, y, z)) AS voxels, min(x) AS min_x, max(z) AS max_z FROM walk GROUP BY 1")
def voxel_ray_traversal(spark: SparkSession, d: str) -> DataFrame:
    return rays.traversal_extents(_segments(spark, d)).select("ray_id", "steps", "voxels", "min_x", "max_z")


@query(f"WITH {VOLUME}, {SEGMENTS}, {WALK} SELECT ray_id, x, y, z FROM walk JOIN volume USING (x, y, z) WHERE gray >= 1800 QUALIFY row_number() OVER (PARTITION BY ray_id ORDER BY nth) = 1")
def first_solid_voxel(spark: SparkSession, d: str) -> DataFrame:
    return rays.first_solid(_segments(spark, d), volume(spark, d), 1800).select("ray_id", "x", "y", "z")


@query(f"WITH {VOLUME}, s AS (SELECT y, z, x, gray, lead(gray) OVER w AS g, lead(x) OVER w AS nx FROM volume WINDOW w AS (PARTITION BY y, z ORDER BY x)) SELECT y, z, round(min(x + (1200 - gray) / (g - gray)), 11) AS px FROM s WHERE nx = x + 1 AND (gray < 1200) <> (g < 1200) GROUP BY 1, 2")
def iso_crossing_on_rays(spark: SparkSession, d: str) -> DataFrame:
    c = rays.iso_crossings(volume(spark, d), 1200)
    return c.select("y", "z", F.round("px", 11).alias("px"))


@query(f"WITH {VOLUME}, d AS (SELECT x, y, z, abs(lead(gray) OVER w - lag(gray) OVER w) AS d FROM volume WINDOW w AS (PARTITION BY y, z ORDER BY x)), n AS (SELECT *, lag(d) OVER w AS l, lead(d) OVER w AS r FROM d WINDOW w AS (PARTITION BY y, z ORDER BY x)) SELECT x, y, z, d AS step, round(x + (l - r) / (2 * (l - 2 * d + r)), 8) AS px FROM n WHERE d >= 600 AND d > l AND d >= r")
def edge_profiles(spark: SparkSession, d: str) -> DataFrame:
    e = rays.edge_profile(volume(spark, d), 600)
    return e.select("x", "y", "z", "step", F.round("px", 8).alias("px"))


def _tiles(spark: SparkSession, d: str) -> DataFrame:
    t = voxel.tile_stats(volume(spark, d), 8).select((F.col("tx") + 10 * F.col("ty") + 100 * F.col("tz")).alias("tile"), "tx", "ty", "tz")
    return t.select("tile", *((F.col(f"t{c}") * 8.0).alias(f"{c}0") for c in "xyz"), *((F.col(f"t{c}") * 8.0 + 8).alias(f"{c}1") for c in "xyz"))


TILES = f"{VOLUME}, tiles AS (SELECT DISTINCT ((x // 8) + 10 * (y // 8) + 100 * (z // 8))::BIGINT AS tile, (x // 8) * 8.0::DOUBLE AS x0, (y // 8) * 8.0::DOUBLE AS y0, (z // 8) * 8.0::DOUBLE AS z0, (x // 8) * 8.0::DOUBLE + 8 AS x1, (y // 8) * 8.0::DOUBLE + 8 AS y1, (z // 8) * 8.0::DOUBLE + 8 AS z1 FROM volume)"
EDGES = " UNION ALL ".join(f"SELECT tile, {', '.join((f'{a}0 AS a{a}, {a}1 AS b{a}' if a == c else f'{a}{(u, v)[o.index(a)]} AS a{a}, {a}{(u, v)[o.index(a)]} AS b{a}') for a in 'xyz')} FROM tiles" for c in "xyz" for o in [[a for a in "xyz" if a != c]] for u in "01" for v in "01")


#: The plane of normal (1, 2, 1) has the axes (5, -2, -1) and (0, 6, -12), both times 6, their lengths' squares 30 and 180.
_CUT = """WITH {TILES}, e AS ({EDGES}), s AS (SELECT *, ax + 2 * ay + az - 30.5 AS da, bx + 2 * "by" + bz - 30.5 AS db FROM e),
p AS (SELECT tile, ax + da / (da - db) * (bx - ax) AS x, ay + da / (da - db) * ("by" - ay) AS y, az + da / (da - db) * (bz - az) AS z FROM s WHERE (da > 0) <> (db > 0)),
c AS (SELECT *, x - avg(x) OVER t AS cx, y - avg(y) OVER t AS cy, z - avg(z) OVER t AS cz FROM p WINDOW t AS (PARTITION BY tile)),
f AS (SELECT *, (5 * cx - 2 * cy - cz) / sqrt(30) AS a, (cy - 2 * cz) / sqrt(5) AS b FROM c),
n AS (SELECT *, coalesce(lead(a) OVER o, first(a) OVER o) AS na, coalesce(lead(b) OVER o, first(b) OVER o) AS nb FROM f WINDOW o AS (PARTITION BY tile ORDER BY atan2(b, a)))
SELECT tile, count(*) AS corners, round(sum(x), 6) AS px, round(sum(y), 6) AS py, round(sum(z), 6) AS pz, round(abs(sum(a * nb - na * b)), 5) AS area2 FROM n GROUP BY tile"""


@query(_CUT.replace("{TILES}", TILES).replace("{EDGES}", EDGES.replace(" AS by,", ' AS "by",').replace(" AS by ", ' AS "by" ')))
def box_plane_polygons(spark: SparkSession, d: str) -> DataFrame:
    p = rays.box_plane_polygons(_tiles(spark, d), "tile", (1, 2, 1), -30.5)
    total = lambda c: F.round(F.aggregate("polygon", F.lit(0.0), lambda s, e: s + e[c]), 6).alias(f"p{c}")
    return p.select("tile", F.size("polygon").cast("long").alias("corners"), *map(total, "xyz"), F.round(rays.polygon_area2("polygon"), 5).alias("area2"))


@query(f"WITH {TILES}, c AS (SELECT tile, 0.6 * a.x - 0.8 * b.y AS tx, 0.8 * a.x + 0.6 * b.y AS ty FROM (SELECT tile, unnest([x0, x1]) AS x FROM tiles) a JOIN (SELECT tile, unnest([y0, y1]) AS y FROM tiles) b USING (tile)) SELECT tile, round(least(greatest(min(tx), 0), 32), 4) AS min_x, round(least(greatest(max(tx), 0), 32), 4) AS max_x, round(least(greatest(min(ty), 0), 32), 4) AS min_y, round(least(greatest(max(ty), 0), 32), 4) AS max_y FROM c GROUP BY 1")
def enclosing_boxes(spark: SparkSession, d: str) -> DataFrame:
    b = rays.enclosing_box(_tiles(spark, d), "tile", [[0.6, -0.8, 0], [0.8, 0.6, 0], [0, 0, 1]], (WIDTH, HEIGHT, depth(spark, d)))
    return b.select("tile", *(F.round(c, 4).alias(c) for c in ("min_x", "max_x", "min_y", "max_y")))


@query(f"{SCORED} SELECT model_id, round(median(sqrt(r)), 6) AS penalty FROM r GROUP BY 1")
def lmeds_penalty(spark: SparkSession, d: str) -> DataFrame:
    m = fit.lmeds(points(spark, d), _planes(spark), fit.plane_residual())
    return m.select("model_id", F.round("penalty", 6).alias("penalty"))


@query(f"WITH {POINTS} SELECT point_id, round(x - (0.6 * x + 0.8 * z - 700) * 0.6, 4) AS x, y, round(z - (0.6 * x + 0.8 * z - 700) * 0.8, 4) AS z FROM points")
def project_onto_plane(spark: SparkSession, d: str) -> DataFrame:
    p = fit.projected(points(spark, d), (0.6, 0.0, 0.8, -700.0))
    return p.select("point_id", F.round("x", 4).alias("x"), F.round("y", 4).alias("y"), F.round("z", 4).alias("z"))


@query(f"WITH {POINTS} SELECT point_id FROM points WHERE abs(0.6 * x + 0.8 * z - 700.05) <= 50")
def model_outlier_removal(spark: SparkSession, d: str) -> DataFrame:
    return fit.near_plane(points(spark, d), (0.6, 0.0, 0.8, -700.05), 50).select("point_id")


@query(f"WITH {POINTS}, {QUERIES}, n AS (SELECT query_id AS a, point_id AS b, (p.x - q.x) * (p.x - q.x) + (p.y - q.y) * (p.y - q.y) + (p.z - q.z) * (p.z - q.z) AS d2 FROM points p, queries q), m AS (SELECT *, row_number() OVER (PARTITION BY a ORDER BY d2, b) AS ra, row_number() OVER (PARTITION BY b ORDER BY d2, a) AS rb FROM n WHERE d2 < 3600) SELECT a, b, d2 FROM m WHERE ra = 1 AND rb = 1")
def reciprocal_correspondences(spark: SparkSession, d: str) -> DataFrame:
    q = queries(spark, d).withColumnRenamed("query_id", "point_id").select("point_id", "x", "y", "z")
    return fit.correspondences(q, points(spark, d), 60)


@query(f"WITH {POINTS}, c AS (SELECT point_id, floor(x / 50)::BIGINT AS cx, floor(y / 50)::BIGINT AS cy, floor(z / 50)::BIGINT AS cz, x, y, z FROM points) SELECT cx, cy, cz, point_id FROM c QUALIFY row_number() OVER (PARTITION BY cx, cy, cz ORDER BY (x - cx * 50 - 25) * (x - cx * 50 - 25) + (y - cy * 50 - 25) * (y - cy * 50 - 25) + (z - cz * 50 - 25) * (z - cz * 50 - 25), point_id) = 1")
def uniform_sampling(spark: SparkSession, d: str) -> DataFrame:
    return voxel.uniform_sample(points(spark, d), 50)


OCCUPIED = f"WITH {POINTS}, {CLOUD}, a AS (SELECT DISTINCT floor(x / 50)::BIGINT AS cx, floor(y / 50)::BIGINT AS cy, floor(z / 50)::BIGINT AS cz FROM points), b AS (SELECT DISTINCT floor(x / 50)::BIGINT AS cx, floor(y / 50)::BIGINT AS cy, floor(z / 50)::BIGINT AS cz FROM cloud)"


@query(f"{OCCUPIED} SELECT * FROM a INTERSECT SELECT * FROM b")
def voxel_intersection(spark: SparkSession, d: str) -> DataFrame:
    return voxel.occupied(points(spark, d), 50).join(voxel.occupied(cloud(spark, d), 50), ["cx", "cy", "cz"], "left_semi")


@query(f"{OCCUPIED} SELECT * FROM a EXCEPT SELECT * FROM b")
def voxel_difference(spark: SparkSession, d: str) -> DataFrame:
    return voxel.occupied(points(spark, d), 50).join(voxel.occupied(cloud(spark, d), 50), ["cx", "cy", "cz"], "left_anti")


@query(f"WITH {VOLUME}, t AS (SELECT 0 AS level, x // 4 AS tx, y // 4 AS ty, z // 4 AS tz, gray FROM volume UNION ALL SELECT 1, x // 8, y // 8, z // 8, gray FROM volume UNION ALL SELECT 2, x // 16, y // 16, z // 16, gray FROM volume), a AS (SELECT level, tx, ty, tz, min(gray) AS lo, max(gray) AS hi FROM t GROUP BY 1, 2, 3, 4) SELECT level, tx::BIGINT AS tx, ty::BIGINT AS ty, tz::BIGINT AS tz, lo, hi, row_number() OVER (PARTITION BY level ORDER BY tz, ty, tx) - 1 AS file_id FROM a")
def octree_tile_ids(spark: SparkSession, d: str) -> DataFrame:
    return voxel.octree_tiles(volume(spark, d), 4, 3)


LOW = f"WITH RECURSIVE {VOLUME}, low AS (SELECT x, y, z, (x + {WIDTH} * (y + {HEIGHT} * z::BIGINT))::BIGINT AS id FROM volume WHERE gray < 150), e AS (SELECT a.id AS a, b.id AS b FROM low a JOIN low b ON abs(a.x - b.x) + abs(a.y - b.y) + abs(a.z - b.z) = 1), walk AS (SELECT id, id AS c FROM low UNION SELECT e.b, walk.c FROM walk JOIN e ON e.a = walk.id), label AS (SELECT id, min(c) AS pore FROM walk GROUP BY 1)"


@query(f"{LOW} SELECT pore, count(*) AS voxels, min(x) AS min_x, max(x) AS max_x, min(y) AS min_y, max(y) AS max_y, min(z) AS min_z, max(z) AS max_z FROM low JOIN label USING (id) GROUP BY 1")
def pore_extraction(spark: SparkSession, d: str) -> DataFrame:
    return voxel.pores(volume(spark, d), 150, WIDTH, HEIGHT)


@query("SELECT o_orderkey, (sum(o_custkey) OVER (ORDER BY o_orderkey) - o_custkey)::BIGINT AS before FROM orders")
def exclusive_prefix_sum(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey")
    return numbering.exclusive_scan(o, "o_orderkey", "o_custkey", "before", 1000).select("o_orderkey", "before")


@query("SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS place FROM orders WHERE o_orderstatus = 'F'")
def stream_compaction(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").filter("o_orderstatus = 'F'").select("o_orderkey")
    return numbering.numbered(o, "o_orderkey", "place", 1000)


@query(f"WITH {VOLUME}, {near_pixels(2)} SELECT z, x, y, count(*) AS n, max(gray) AS top FROM w WHERE abs(gray - own) < 300 GROUP BY 1, 2, 3")
def organised_neighbours(spark: SparkSession, d: str) -> DataFrame:
    return stencil.like_neighbours(volume(spark, d), 2, 300, by=("z",))


@query(f"WITH {VOLUME}, {near_pixels(2)}, m AS (SELECT z, x, y, own, avg(gray) AS m FROM w GROUP BY 1, 2, 3, 4) SELECT z, x, y, (own > m + 50)::INT AS value FROM m")
def adaptive_threshold(spark: SparkSession, d: str) -> DataFrame:
    i = volume(spark, d)
    return i.join(stencil.image_filter(i, "mean", 2, by=("z",)), ["z", "x", "y"]).select("z", "x", "y", (F.col("gray") > F.col("value") + 50).cast("int").alias("value"))


@query(f"WITH {VOLUME}, s AS (SELECT z, min(gray) AS lo, max(gray) AS hi FROM volume GROUP BY 1) SELECT x, y, z, floor((gray - lo) * 255 / greatest(hi - lo, 1))::BIGINT AS value FROM volume JOIN s USING (z)")
def image_normalisation(spark: SparkSession, d: str) -> DataFrame:
    v = volume(spark, d)
    s = v.groupBy("z").agg(F.min("gray").alias("lo"), F.max("gray").alias("hi"))
    return v.join(s, "z").select("x", "y", "z", F.floor((F.col("gray") - F.col("lo")) * 255 / F.greatest(F.col("hi") - F.col("lo"), F.lit(1))).alias("value"))


PIXELS = DEPTH + ", pixels AS (SELECT c_custkey AS sample_id, 2 + (c_custkey % 40) * 0.5 + (c_custkey // 40) * 0.125 AS x, 3 + (c_custkey // 40) * 0.5 AS y, (c_custkey % 40) * depth // 40 + 0.25 AS z FROM customer, dims)"


@query(f"WITH {VOLUME}, {PIXELS}, s AS (SELECT pixels.*, floor(x)::INT AS fx, floor(y)::INT AS fy, floor(z)::INT AS fz FROM pixels, dims WHERE x >= 1 AND x < 31 AND y >= 1 AND y < 31 AND z >= 1 AND z < depth - 1), o AS (SELECT unnest([0, 1]) AS o), c AS (SELECT sample_id, fx + a.o AS cx, fy + b.o AS cy, fz + c.o AS cz, (CASE WHEN a.o = 1 THEN x - fx ELSE 1 - (x - fx) END) * (CASE WHEN b.o = 1 THEN y - fy ELSE 1 - (y - fy) END) * (CASE WHEN c.o = 1 THEN z - fz ELSE 1 - (z - fz) END) AS w FROM s, o a, o b, o c), v AS (SELECT sample_id, sum(w * gray) AS v FROM c JOIN volume v ON v.x = cx AND v.y = cy AND v.z = cz GROUP BY 1), g AS (SELECT sample_id, floor(coalesce(v, 0))::INT AS gray FROM pixels LEFT JOIN v USING (sample_id)) SELECT sample_id, gray, (gray * 255 // 2400)::INT AS red, 255 - (gray * 255 // 2400)::INT AS blue FROM g")
def oblique_slice(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("c_custkey")
    row, col, n = F.floor(k / 40), k % 40, depth(spark, d)
    px = table(spark, d, "customer").select(k.alias("sample_id"), (2 + col * 0.5 + row * 0.125).alias("x"), (3 + row * 0.5).alias("y"), (F.floor(col * n / 40) + 0.25).alias("z"))
    s = voxel.trilinear(volume(spark, d), px, (WIDTH, HEIGHT, n))
    red = F.floor(F.col("value") * 255 / 2400).cast("int")
    return s.select("sample_id", F.col("value").alias("gray"), red.alias("red"), (255 - red).alias("blue"))


@query(f"WITH {POINTS}, {QUERIES} SELECT query_id, count(*) AS n FROM points p, queries q WHERE (p.x - q.x) * (p.x - q.x) + (p.y - q.y) * (p.y - q.y) + (p.z - q.z) * (p.z - q.z) < 2500 GROUP BY 1")
def radius_counts(spark: SparkSession, d: str) -> DataFrame:
    return neighbors.radius_join(points(spark, d), queries(spark, d), 50).groupBy("query_id").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {POINTS}, {CLOUD} SELECT p.point_id, p.x, p.y, p.z, c.v AS extra FROM points p JOIN cloud c USING (point_id)")
def concatenate_fields(spark: SparkSession, d: str) -> DataFrame:
    extra = cloud(spark, d).select("point_id", F.col("v").alias("extra"))
    return points(spark, d).select("point_id", "x", "y", "z").join(extra, "point_id")


@query(f"""WITH {CLOUD}, m AS (SELECT count(*) AS n, sum(v) AS w, {", ".join(f"sum(v * {c}) / sum(v) AS {c}" for c in "xyz")} FROM cloud),
k AS (SELECT {", ".join(f"sum(v * (c.{a} - m.{a}) * (c.{b} - m.{b})) / any_value(m.w) AS cov_{a}{b}" for a, b in ("xx", "xy", "xz", "yy", "yz", "zz"))} FROM cloud c, m)
SELECT n, {", ".join(f"round({c}, 4) AS {c}" for c in "xyz")}, {", ".join(f"round(cov_{p}, 2) AS cov_{p}" for p in ("xx", "xy", "xz", "yy", "yz", "zz"))} FROM m, k""")
def weighted_mean(spark: SparkSession, d: str) -> DataFrame:
    m = fit.weighted_moments(cloud(spark, d), "v")
    return m.select("n", *(F.round(f"mean_{c}", 4).alias(c) for c in "xyz"), *(F.round(f"cov_{p}", 2).alias(f"cov_{p}") for p in ("xx", "xy", "xz", "yy", "yz", "zz")))


@query()
def signed_distances(spark: SparkSession, d: str) -> DataFrame:
    v = volume(spark, d)
    s = surface.crossings(v, 1200)
    key = F.xxhash64("axis", "x", "y", "z")
    at = s.select(key.alias("point_id"), *(F.col(f"p{c}").cast("double").alias(c) for c in "xyz"))
    q = v.select((F.col("x") + 32 * F.col("y") + 1024 * F.col("z").cast("long")).alias("query_id"), *(F.col(c).cast("double").alias(c) for c in "xyz"), "gray")
    return surface.signed_distance(at, q, 1200)


HEAD, BODY = SOBEL.split(" SELECT s.x", 1)
ENDS = "".join(f", e{c} AS (SELECT 0 AS o{c} UNION ALL SELECT 1)" for c in "xyz")


@query(f"""{HEAD}, sobel AS (SELECT s.x{BODY}), g AS (SELECT x, y, z, gx / m AS nx, gy / m AS ny, gz / m AS nz FROM (SELECT *, sqrt(gx::DOUBLE * gx + gy::DOUBLE * gy + gz::DOUBLE * gz) AS m FROM sobel) WHERE m >= 5000),
p AS (SELECT x, y, z, s, x + s * nx AS sx, y + s * ny AS sy, z + s * nz AS sz FROM g, (SELECT unnest(range(-3, 4)) AS s)){ENDS},
c AS (SELECT x, y, z, s, floor(sx)::INT + ox AS cx, floor(sy)::INT + oy AS cy, floor(sz)::INT + oz AS cz, (CASE WHEN ox = 1 THEN sx - floor(sx) ELSE 1 - (sx - floor(sx)) END) * (CASE WHEN oy = 1 THEN sy - floor(sy) ELSE 1 - (sy - floor(sy)) END) * (CASE WHEN oz = 1 THEN sz - floor(sz) ELSE 1 - (sz - floor(sz)) END) AS w FROM p, ex, ey, ez),
v AS (SELECT c.x, c.y, c.z, s, CASE WHEN sum(w) > 1 - 1e-9 THEN sum(w * gray) END AS v FROM c JOIN volume o ON o.x = cx AND o.y = cy AND o.z = cz WHERE w > 0 GROUP BY 1, 2, 3, 4),
every AS (SELECT g.x, g.y, g.z, nx, ny, nz, i.s, v FROM g CROSS JOIN (SELECT unnest(range(-3, 4)) AS s) i LEFT JOIN v ON v.x = g.x AND v.y = g.y AND v.z = g.z AND v.s = i.s),
d AS (SELECT *, abs(lead(v) OVER o - lag(v) OVER o) / 2 AS d FROM every WINDOW o AS (PARTITION BY x, y, z ORDER BY s)),
n AS (SELECT *, lag(d) OVER o AS l, lead(d) OVER o AS r FROM d WINDOW o AS (PARTITION BY x, y, z ORDER BY s))
SELECT x, y, z, round(nx, 6) AS nx, round(ny, 6) AS ny, round(nz, 6) AS nz, round(s + CASE WHEN l - 2 * d + r < 0 THEN (l - r) / (2 * (l - 2 * d + r)) ELSE 0 END, 5) AS place, round(d, 5) AS step FROM n WHERE d IS NOT NULL QUALIFY row_number() OVER (PARTITION BY x, y, z ORDER BY d DESC, abs(s), s DESC) = 1""")
def gradient_profiles(spark: SparkSession, d: str) -> DataFrame:
    p = rays.gradient_profiles(volume(spark, d), 5000)
    return p.select("x", "y", "z", *(F.round(c, 6).alias(c) for c in ("nx", "ny", "nz")), F.round("offset", 5).alias("place"), F.round("step", 5).alias("step"))
