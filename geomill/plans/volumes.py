"""Queries on voxel volumes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from geomill.operators import filters, stencil, surface, voxel
from geomill.plans.registry import Registry
from geomill.plans.tables import DEPTH, HEIGHT, VOLUME, WIDTH, depth, volume

query = Registry()
SOLID = 1200


@query(f"WITH {VOLUME}, s AS (SELECT count(*) AS n, sum(x) AS sx, sum(y) AS sy, sum(z) AS sz FROM volume WHERE gray >= {SOLID}) SELECT n, floor(sx / n)::BIGINT AS cog_x, floor(sy / n)::BIGINT AS cog_y, floor(sz / n)::BIGINT AS cog_z, round(sx / n * 0.5, 4) AS world_x, round(sy / n * 0.5, 4) AS world_y, round(sz / n * 0.5, 4) AS world_z FROM s")
def centre_of_gravity(spark: SparkSession, d: str) -> DataFrame:
    c = voxel.centre_of_gravity(volume(spark, d), SOLID, 0.5)
    return c.select("n", "cog_x", "cog_y", "cog_z", *(F.round(f"world_{a}", 4).alias(f"world_{a}") for a in "xyz"))


@query(f"WITH {VOLUME}, s AS (SELECT count(*) AS n, floor(avg(x)) AS cx, floor(avg(y)) AS cy, floor(avg(z)) AS cz FROM volume WHERE gray >= {SOLID}), r AS (SELECT x - cx AS dx, y - cy AS dy, z - cz AS dz FROM volume, s WHERE gray >= {SOLID}) SELECT round(sum(dy * dy + dz * dz) / count(*), 4) AS ixx, round(sum(dx * dx + dz * dz) / count(*), 4) AS iyy, round(sum(dx * dx + dy * dy) / count(*), 4) AS izz, round(-sum(dx * dy) / count(*), 4) AS ixy, round(-sum(dx * dz) / count(*), 4) AS ixz, round(-sum(dy * dz) / count(*), 4) AS iyz FROM r")
def inertia_tensor(spark: SparkSession, d: str) -> DataFrame:
    t = voxel.inertia_tensor(volume(spark, d), SOLID)
    return t.select(*(F.round(c, 4).alias(c) for c in t.columns))


@query(f"WITH {VOLUME} SELECT g.gray, coalesce(n, 0) AS n FROM (SELECT range::INT AS gray FROM range(65536)) g LEFT JOIN (SELECT gray, count(*) AS n FROM volume GROUP BY 1) h ON g.gray = h.gray")
def gray_histogram(spark: SparkSession, d: str) -> DataFrame:
    return voxel.histogram(volume(spark, d))


@query(f"WITH {VOLUME} SELECT x, y, z, gray FROM volume WHERE gray >= {SOLID}")
def threshold(spark: SparkSession, d: str) -> DataFrame:
    return volume(spark, d).filter(F.col("gray") >= SOLID)


@query(f"WITH {VOLUME} SELECT y, z, gray FROM volume WHERE x = 7")
def axis_slice(spark: SparkSession, d: str) -> DataFrame:
    return volume(spark, d).filter("x = 7").select("y", "z", "gray")


@query(f"WITH {VOLUME} SELECT floor(x / 8)::BIGINT AS tx, floor(y / 8)::BIGINT AS ty, floor(z / 8)::BIGINT AS tz, min(gray) AS lo, max(gray) AS hi, count(*) AS n, sum(gray)::BIGINT AS total FROM volume GROUP BY 1, 2, 3")
def tile_stats(spark: SparkSession, d: str) -> DataFrame:
    return voxel.tile_stats(volume(spark, d), 8)


@query(f"WITH {VOLUME}, t AS (SELECT DISTINCT x // 8 AS tx, y // 8 AS ty, z // 8 AS tz FROM volume), c AS (SELECT tx, ty, tz, (tx * 8 + ty * 8 + tz * 8 - 30.5) AS lo, (tx * 8 + ty * 8 + tz * 8 + 24 - 30.5) AS hi FROM t) SELECT tx::BIGINT AS tx, ty::BIGINT AS ty, tz::BIGINT AS tz FROM c WHERE lo < 0 AND hi > 0")
def tiles_cut_by_plane(spark: SparkSession, d: str) -> DataFrame:
    t = voxel.tile_stats(volume(spark, d), 8).select("tx", "ty", "tz", *((F.col(f"t{c}") * 8).alias(f"{c}0") for c in "xyz"), *((F.col(f"t{c}") * 8 + 8).alias(f"{c}1") for c in "xyz"))
    return filters.tiles_cut_by_plane(t, (1, 1, 1), -30.5).select("tx", "ty", "tz")


@query(f"WITH {VOLUME}, b AS (SELECT x // 8 AS hx, y // 8 AS hy, z // 8 AS hz, CASE WHEN gray < 200 THEN -1 WHEN gray >= 2000 THEN 18 ELSE (gray - 200) // 100 END AS bin FROM volume), o AS (SELECT unnest([0, 1]) AS o) SELECT (hx - a.o)::BIGINT AS cx, (hy - b2.o)::BIGINT AS cy, (hz - c.o)::BIGINT AS cz, bin::BIGINT AS bin, count(*) AS n FROM b, o a, o b2, o c WHERE hx - a.o >= 0 AND hy - b2.o >= 0 AND hz - c.o >= 0 GROUP BY 1, 2, 3, 4")
def overlapping_histograms(spark: SparkSession, d: str) -> DataFrame:
    return voxel.sub_histograms(volume(spark, d), 8, 200, 2000, 100)


@query(f"WITH {VOLUME} SELECT min(x) AS min_x, max(x) AS max_x, min(y) AS min_y, max(y) AS max_y, min(z) AS min_z, max(z) AS max_z FROM volume WHERE gray >= 2200")
def solid_bounding_box(spark: SparkSession, d: str) -> DataFrame:
    return voxel.bounding_box(volume(spark, d).filter("gray >= 2200"))


@query(f"WITH {VOLUME}, g AS (SELECT a.range AS x, b.range AS y, c.range AS z FROM range(28, 40) a, range(10, 20) b, range(0, 6) c) SELECT (g.x - 28)::INT AS x, (g.y - 10)::INT AS y, g.z::INT AS z, coalesce(gray, 0) AS gray FROM g LEFT JOIN volume v ON v.x = g.x AND v.y = g.y AND v.z = g.z")
def padded_region(spark: SparkSession, d: str) -> DataFrame:
    return voxel.roi(volume(spark, d), (28, 10, 0), (40, 20, 6)).select(*(F.col(c).cast("int").alias(c) for c in "xyz"), "gray")


@query(f"WITH {VOLUME} SELECT (x >> 2) AS x, (y >> 2) AS y, (z >> 2) AS z, count(*) AS n, sum(gray)::BIGINT AS total, min(gray) AS lo, max(gray) AS hi FROM volume GROUP BY 1, 2, 3")
def octree_rollup(spark: SparkSession, d: str) -> DataFrame:
    return voxel.level_means(volume(spark, d), 2)


@query(f"WITH {VOLUME} SELECT (x // 2)::INT AS x, (y // 2)::INT AS y, (z // 2)::INT AS z, gray FROM volume WHERE x % 2 = 0 AND y % 2 = 0 AND z % 2 = 0")
def octant_decimation(spark: SparkSession, d: str) -> DataFrame:
    return voxel.decimate(volume(spark, d), 2)


@query(f"WITH {VOLUME} SELECT l.range::INT AS level, x >> l.range::INT AS x, y >> l.range::INT AS y, z >> l.range::INT AS z, gray FROM volume, range(3) l WHERE x % (1 << l.range::INT) = 0 AND y % (1 << l.range::INT) = 0 AND z % (1 << l.range::INT) = 0")
def tile_pyramid(spark: SparkSession, d: str) -> DataFrame:
    return voxel.pyramid(volume(spark, d), 3)


SAMPLES = "samples AS (SELECT c_custkey AS sample_id, (c_custkey * 37 % 310) / 10.0::DOUBLE AS x, (c_custkey * 53 % 310) / 10.0::DOUBLE AS y, (c_custkey * 29 % (10 * depth)) / 10.0::DOUBLE AS z FROM customer, dims)"


def _samples(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("c_custkey")
    return spark.read.parquet(f"{d}/customer.parquet").select(k.alias("sample_id"), (k * 37 % 310 / 10.0).alias("x"), (k * 53 % 310 / 10.0).alias("y"), (k * 29 % (10 * depth(spark, d)) / 10.0).alias("z"))


@query(f"WITH {VOLUME}, {DEPTH}, {SAMPLES}, s AS (SELECT samples.*, floor(x)::INT AS fx, floor(y)::INT AS fy, floor(z)::INT AS fz FROM samples, dims WHERE x >= 1 AND x < 31 AND y >= 1 AND y < 31 AND z >= 1 AND z < depth - 1), o AS (SELECT unnest([0, 1]) AS o), c AS (SELECT sample_id, fx + a.o AS cx, fy + b.o AS cy, fz + c.o AS cz, (CASE WHEN a.o = 1 THEN x - fx ELSE 1 - (x - fx) END) * (CASE WHEN b.o = 1 THEN y - fy ELSE 1 - (y - fy) END) * (CASE WHEN c.o = 1 THEN z - fz ELSE 1 - (z - fz) END) AS w FROM s, o a, o b, o c), v AS (SELECT sample_id, sum(w * gray) AS value FROM c JOIN volume v ON v.x = cx AND v.y = cy AND v.z = cz GROUP BY 1) SELECT sample_id, round(coalesce(value, 0), 4) AS value FROM samples LEFT JOIN v USING (sample_id)")
def trilinear_samples(spark: SparkSession, d: str) -> DataFrame:
    return voxel.trilinear(volume(spark, d), _samples(spark, d), (WIDTH, HEIGHT, depth(spark, d)), truncate=False).select("sample_id", F.round("value", 4).alias("value"))


def _resized(c: str, d: str, t: str) -> str:
    """Places along one axis: target p, source at, weight w."""
    s = f"least(greatest((p + 0.5) * {d} / {t} - 0.5, 0), {d} - 1)"
    return f"r{c} AS (SELECT p, floor(s)::INT + o AS at, CASE WHEN o = 1 THEN s - floor(s) ELSE 1 - (s - floor(s)) END AS w FROM (SELECT p, {s} AS s FROM (SELECT unnest(range(0, {t}::BIGINT)) AS p, depth FROM dims)), (SELECT unnest([0, 1]) AS o) WHERE (o = 0 OR s > floor(s)))"


TIGHT = "greatest(1, depth // 2)"


@query(f"WITH {VOLUME}, {DEPTH}, {_resized('x', str(WIDTH), '20')}, {_resized('y', str(HEIGHT), '20')}, {_resized('z', 'depth', TIGHT)} SELECT (x.p + 20 * (y.p + 20 * z.p))::BIGINT AS sample_id, round(sum(x.w * y.w * z.w * gray), 4) AS value FROM volume v JOIN rx x ON x.at = v.x JOIN ry y ON y.at = v.y JOIN rz z ON z.at = v.z GROUP BY 1")
def resized_volume(spark: SparkSession, d: str) -> DataFrame:
    n = depth(spark, d)
    return voxel.resized(volume(spark, d), (WIDTH, HEIGHT, n), (20, 20, max(1, n // 2))).select("sample_id", F.round("value", 4).alias("value"))


MATERIALS = "regions AS (SELECT * FROM (VALUES (0, 0, 600), (1, 600, 1200), (2, 1200, 4096)) t(material_id, lo, hi))"


def _materials(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(0, 0, 600), (1, 600, 1200), (2, 1200, 4096)], "material_id int, lo int, hi int")


@query(f"WITH {VOLUME}, {MATERIALS} SELECT x, y, z, material_id FROM volume JOIN regions ON gray >= lo AND gray < hi")
def material_lookup(spark: SparkSession, d: str) -> DataFrame:
    return voxel.material_of(volume(spark, d), _materials(spark)).select("x", "y", "z", "material_id")


@query(f"WITH {VOLUME}, {MATERIALS}, h AS (SELECT gray, count(*) AS n FROM volume GROUP BY 1), m AS (SELECT material_id, gray::DOUBLE AS g, n FROM h JOIN regions ON gray >= lo AND gray < hi), s AS (SELECT material_id, sum(n)::BIGINT AS n, sum(n * g) AS s, sum(n * g * g) AS q FROM m GROUP BY 1), p AS (SELECT material_id, g AS peak FROM m QUALIFY row_number() OVER (PARTITION BY material_id ORDER BY n DESC, g) = 1) SELECT material_id, n, peak::INT AS peak, ceil(s / n)::BIGINT AS mean, ceil(sqrt(greatest(q / n - 2 * peak * (s / n) + peak * peak, 0)))::BIGINT AS about_peak, ceil(sqrt(greatest(q / n - 2 * (s / n) * (s / n) + (s / n) * (s / n), 0)))::BIGINT AS about_mean FROM s JOIN p USING (material_id)")
def material_statistics(spark: SparkSession, d: str) -> DataFrame:
    return voxel.region_stats(volume(spark, d).groupBy("gray").agg(F.count(F.lit(1)).alias("n")), _materials(spark))


HIST = f"WITH {VOLUME}, hist AS (SELECT g.range::INT AS gray, coalesce(n, 0) AS n FROM range(2400) g LEFT JOIN (SELECT gray, count(*) AS n FROM volume GROUP BY 1) h ON g.range = h.gray)"


def _hist(spark: SparkSession, d: str) -> DataFrame:
    return voxel.histogram(volume(spark, d), 2400)


@query(f"{HIST}, t AS (SELECT sum(n) AS w, sum(gray * n) AS s FROM hist), c AS (SELECT gray, sum(n) OVER o AS w0, sum(gray * n) OVER o AS s0 FROM hist WINDOW o AS (ORDER BY gray)), b AS (SELECT gray, w0::DOUBLE * (w - w0) * (s0 / w0 - (s - s0) / (w - w0)) * (s0 / w0 - (s - s0) / (w - w0)) AS b FROM c, t WHERE w0 > 0 AND w0 < w) SELECT gray AS threshold FROM b ORDER BY b DESC, gray LIMIT 1")
def otsu_threshold(spark: SparkSession, d: str) -> DataFrame:
    return voxel.otsu(_hist(spark, d)).select("threshold")


@query(f"{HIST} SELECT gray, n, round((coalesce(lag(n, 2) OVER o, 0) * 1 + coalesce(lag(n, 1) OVER o, 0) * 4 + n * 6 + coalesce(lead(n, 1) OVER o, 0) * 4 + coalesce(lead(n, 2) OVER o, 0) * 1) / 16, 4) AS smooth FROM hist WINDOW o AS (ORDER BY gray)")
def gaussian_histogram(spark: SparkSession, d: str) -> DataFrame:
    return voxel.smoothed(_hist(spark, d), [1, 4, 6, 4, 1]).select("gray", "n", F.round("smooth", 4).alias("smooth"))


@query(f"{HIST}, w AS (SELECT gray, n, list_sort(list(n) OVER (ORDER BY gray ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)) AS s FROM hist) SELECT gray, n, s[(len(s) - 1) // 2 + 1] AS smooth FROM w")
def median_histogram(spark: SparkSession, d: str) -> DataFrame:
    return voxel.medians(_hist(spark, d), 2)


@query(f"{HIST}, m AS (SELECT gray, n, max(n) OVER (ORDER BY gray ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING) AS a, max(n) OVER (ORDER BY gray ROWS BETWEEN 1 FOLLOWING AND 10 FOLLOWING) AS b FROM hist) SELECT gray, n FROM m WHERE n > coalesce(a, -1) AND n > coalesce(b, -1)")
def histogram_peaks(spark: SparkSession, d: str) -> DataFrame:
    return voxel.local_maxima(_hist(spark, d), 10)


@query(f"{HIST}, m AS (SELECT gray, n, max(n) OVER (ORDER BY gray ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING) AS a, max(n) OVER (ORDER BY gray ROWS BETWEEN 1 FOLLOWING AND 10 FOLLOWING) AS b FROM hist), t AS (SELECT gray FROM m WHERE n > coalesce(a, -1) AND n > coalesce(b, -1) ORDER BY n DESC, gray LIMIT 2) SELECT avg(gray) AS threshold, min(gray) AS air, max(gray) AS material FROM t")
def iso50_threshold(spark: SparkSession, d: str) -> DataFrame:
    return voxel.iso50(voxel.local_maxima(_hist(spark, d), 10))


@query(f"{HIST}, m AS (SELECT gray, n, max(n) OVER (ORDER BY gray ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING) AS a, max(n) OVER (ORDER BY gray ROWS BETWEEN 1 FOLLOWING AND 10 FOLLOWING) AS b FROM hist), p AS (SELECT gray, n FROM m WHERE n > coalesce(a, -1) AND n > coalesce(b, -1)) SELECT p.gray, p.n, round(sqrt(sum(h.n * (h.gray - p.gray) ^ 2) FILTER (WHERE h.gray <= p.gray) / sum(h.n) FILTER (WHERE h.gray <= p.gray)), 4) AS left_width, round(sqrt(sum(h.n * (h.gray - p.gray) ^ 2) FILTER (WHERE h.gray >= p.gray) / sum(h.n) FILTER (WHERE h.gray >= p.gray)), 4) AS right_width FROM p JOIN hist h ON abs(h.gray - p.gray) <= 30 GROUP BY 1, 2")
def split_normal_peaks(spark: SparkSession, d: str) -> DataFrame:
    h = _hist(spark, d)
    s = voxel.split_normals(h, voxel.local_maxima(h, 10), 30)
    return s.select("gray", "n", F.round("left", 4).alias("left_width"), F.round("right", 4).alias("right_width"))


def _around(expr: str) -> str:
    return f"SELECT a.x, a.y, a.z, {expr} FROM volume a JOIN volume b ON abs(a.x - b.x) <= 1 AND abs(a.y - b.y) <= 1 AND abs(a.z - b.z) <= 1"


def _near(expr: str, having: str = "") -> str:
    """Neighbour sums with equi-joins on offsets, for speed."""
    offsets = "off AS (SELECT i.o AS i, j.o AS j, k.o AS k FROM (SELECT unnest([-1, 0, 1]) AS o) i, (SELECT unnest([-1, 0, 1]) AS o) j, (SELECT unnest([-1, 0, 1]) AS o) k)"
    return f"WITH {VOLUME}, {offsets}, sent AS (SELECT x - i AS x, y - j AS y, z - k AS z, i, j, k, gray FROM volume, off) SELECT s.x, s.y, s.z, {expr} FROM sent s JOIN volume v ON s.x = v.x AND s.y = v.y AND s.z = v.z GROUP BY ALL {having}"


SOBEL = _near("sum(-i * (2 - abs(j)) * (2 - abs(k)) * s.gray)::BIGINT AS gx, sum(-j * (2 - abs(i)) * (2 - abs(k)) * s.gray)::BIGINT AS gy, sum(-k * (2 - abs(i)) * (2 - abs(j)) * s.gray)::BIGINT AS gz", "HAVING count(*) = 27")


@query(SOBEL)
def sobel_gradient(spark: SparkSession, d: str) -> DataFrame:
    return stencil.sobel(volume(spark, d))


@query(f"WITH {VOLUME} SELECT v.x, v.y, v.z, {", ".join(f"(n{c}.gray - p{c}.gray) / 2 AS d{c}" for c in "xyz")} FROM volume v {" ".join(f"LEFT JOIN volume {t}{c} ON " + " AND ".join(f"{t}{c}.{o} = v.{o}" + (f" {sign} 1" if o == c else "") for o in "xyz") for c in "xyz" for t, sign in (("p", "-"), ("n", "+")))}")
def central_difference(spark: SparkSession, d: str) -> DataFrame:
    return stencil.central_difference(volume(spark, d)).select("x", "y", "z", "dx", "dy", "dz")


@query(_near("CASE WHEN v.gray < 300 THEN 0 WHEN min(s.gray) < 300 THEN 1 ELSE 2 END AS kind").replace("GROUP BY ALL", "GROUP BY s.x, s.y, s.z, v.gray"))
def border_classification(spark: SparkSession, d: str) -> DataFrame:
    return stencil.classified(volume(spark, d), 300)


#: Every slice is an image, and each pixel meets those at most K away on either axis.
def near_pixels(k: int, columns: str = "b.gray") -> str:
    return f"offsets AS (SELECT a.o AS i, b.o AS j FROM (SELECT unnest(range({-k}, {k + 1})) AS o) a, (SELECT unnest(range({-k}, {k + 1})) AS o) b), sent AS (SELECT z, x + i AS x, y + j AS y, i, j, gray FROM volume, offsets), w AS (SELECT a.z, a.x, a.y, a.gray AS own, b.i, b.j, b.gray FROM volume a JOIN sent b ON a.z = b.z AND a.x = b.x AND a.y = b.y)"


IMAGE = f"WITH {VOLUME}, {near_pixels(1)}"


@query(f"{IMAGE} SELECT z, x, y, min(gray) AS value FROM w GROUP BY 1, 2, 3")
def image_erosion(spark: SparkSession, d: str) -> DataFrame:
    return stencil.image_filter(volume(spark, d), "erode", by=("z",))


@query(f"{IMAGE} SELECT z, x, y, max(gray) AS value FROM w GROUP BY 1, 2, 3")
def image_dilation(spark: SparkSession, d: str) -> DataFrame:
    return stencil.image_filter(volume(spark, d), "dilate", by=("z",))


@query(f"{IMAGE}, s AS (SELECT z, x, y, list_sort(list(gray)) AS s FROM w GROUP BY 1, 2, 3) SELECT z, x, y, s[(len(s) - 1) // 2 + 1] AS value FROM s")
def image_median(spark: SparkSession, d: str) -> DataFrame:
    return stencil.image_filter(volume(spark, d), "median", by=("z",))


@query(f"{IMAGE}, g AS (SELECT z, x, y, gray, (2 - abs(i)) * (2 - abs(j)) AS k FROM w) SELECT z, x, y, round(sum(k * gray)::DOUBLE / sum(k), 4) AS value FROM g GROUP BY 1, 2, 3")
def image_gaussian(spark: SparkSession, d: str) -> DataFrame:
    g = stencil.convolved(volume(spark, d), [[1, 2, 1], [2, 4, 2], [1, 2, 1]], by=("z",))
    return g.select("z", "x", "y", F.round("value", 4).alias("value"))


@query(f"WITH {VOLUME}, r AS (SELECT z, x, y, sum(gray) OVER (PARTITION BY z, y ORDER BY x) AS r FROM volume) SELECT z, x, y, (sum(r) OVER (PARTITION BY z, x ORDER BY y))::BIGINT AS total FROM r")
def integral_image(spark: SparkSession, d: str) -> DataFrame:
    return stencil.integral_image(volume(spark, d), by=("z",))


@query(f"WITH {VOLUME}, g AS (SELECT y, z, x, x - row_number() OVER (PARTITION BY y, z ORDER BY x) AS g FROM volume WHERE gray >= {SOLID}) SELECT y, z, min(x) AS start, count(*) AS length FROM g GROUP BY y, z, g")
def run_lengths(spark: SparkSession, d: str) -> DataFrame:
    return stencil.run_lengths(volume(spark, d), SOLID)


def _grown(src: str, name: str) -> str:
    """What a round reaches: the 26 neighbours of all that was reached off the outer layer."""
    return f"""{name} AS (SELECT x, y, z FROM {src} UNION SELECT v.x, v.y, v.z FROM volume v JOIN {src} r ON abs(v.x - r.x) <= 1 AND abs(v.y - r.y) <= 1 AND abs(v.z - r.z) <= 1, dims WHERE r.x BETWEEN 1 AND {WIDTH - 2} AND r.y BETWEEN 1 AND {HEIGHT - 2} AND r.z BETWEEN 1 AND depth - 2)"""


@query(f"""WITH {VOLUME}, {DEPTH}, s0 AS (SELECT x, y, z FROM volume WHERE gray = 1000), {_grown('s0', 's1')}, {_grown('s1', 's2')}, {_grown('s2', 's3')}
SELECT v.x, v.y, v.z, CASE WHEN s3.x IS NULL THEN NULL WHEN gray < 600 THEN 'DB' WHEN gray > 1400 THEN 'DF' WHEN gray > 600 AND gray < 1000 THEN 'PB' WHEN gray >= 1000 AND gray < 1400 THEN 'PF' END AS label FROM volume v LEFT JOIN s3 USING (x, y, z)""")
def band_labels(spark: SparkSession, d: str) -> DataFrame:
    return stencil.band_labels(volume(spark, d), (WIDTH, HEIGHT, depth(spark, d)), 1000, 400, 3)


BINS = "bins AS (SELECT (gray // 200 * 200)::INT AS start, count(*) AS n, min(gray) AS lo, max(gray) AS hi FROM volume GROUP BY 1)"


@query(f"WITH {VOLUME}, {BINS} SELECT start, n, lo, hi, row_number() OVER (ORDER BY start DESC) AS place FROM bins")
def materials_by_start(spark: SparkSession, d: str) -> DataFrame:
    bins = volume(spark, d).groupBy((F.floor(F.col("gray") / 200) * 200).cast("int").alias("start")).agg(F.count(F.lit(1)).alias("n"), F.min("gray").alias("lo"), F.max("gray").alias("hi"))
    return voxel.materials_by_start(bins).select("start", "n", "lo", "hi", F.col("place").cast("long").alias("place"))


CASE = " + ".join(f"(c{b}.gray < {SOLID})::INT * {1 << b}" for b in range(8))
JOINS = " ".join(f"JOIN volume c{b} ON c{b}.x = a.x + {i} AND c{b}.y = a.y + {j} AND c{b}.z = a.z + {k}" for b, (i, j, k) in enumerate(surface.CORNERS))


@query(f"WITH {VOLUME}, c AS (SELECT a.x, a.y, a.z, ({CASE})::BIGINT AS case_idx FROM volume a {JOINS}) SELECT * FROM c WHERE case_idx NOT IN (0, 255)")
def cube_cases(spark: SparkSession, d: str) -> DataFrame:
    return surface.cases(volume(spark, d), SOLID)


def _edge(axis: str) -> str:
    step = " AND ".join(f"b.{c} = a.{c} + {int(c == axis)}" for c in "xyz")
    put = ", ".join(f"round(a.{c} + {f'({SOLID} - a.gray) / (b.gray - a.gray)' if c == axis else '0'}, 11) AS p{c}" for c in "xyz")
    return f"SELECT '{axis}' AS axis, a.x, a.y, a.z, {put} FROM volume a JOIN volume b ON {step} WHERE (a.gray < {SOLID}) <> (b.gray < {SOLID})"


@query(f"WITH {VOLUME} " + " UNION ALL ".join(map(_edge, "xyz")))
def surface_vertices(spark: SparkSession, d: str) -> DataFrame:
    return surface.crossings(volume(spark, d), SOLID).select("axis", "x", "y", "z", *(F.round(f"p{c}", 11).alias(f"p{c}") for c in "xyz"))


@query()
def surface_triangles(spark: SparkSession, d: str) -> DataFrame:
    return surface.cell_triangles(volume(spark, d), SOLID)


@query(f"WITH {VOLUME}, t AS (SELECT x // 8 AS tx, y // 8 AS ty, z // 8 AS tz, max(gray) AS weight FROM volume GROUP BY 1, 2, 3) SELECT tx::BIGINT AS tx, ty::BIGINT AS ty, tz::BIGINT AS tz, weight FROM t ORDER BY weight DESC, tz, ty, tx LIMIT 10")
def heaviest_tiles(spark: SparkSession, d: str) -> DataFrame:
    t = voxel.tile_stats(volume(spark, d), 8).select("tx", "ty", "tz", F.col("hi").alias("weight"))
    return t.orderBy(F.desc("weight"), "tz", "ty", "tx").limit(10)
