"""Queries on feature vectors and scalar functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from geomill.functions import colour, time
from geomill.functions import geometry as g
from geomill.functions import vectors as v
from geomill.operators import ann, fit
from geomill.plans.registry import Registry
from geomill.plans.tables import POINTS, VOLUME, points, table, volume

query = Registry()
#: Pairs of neighbouring ids: each vector with the next one.
PAIR = "WITH p AS (SELECT a.vec_id, a.embedding AS a, b.embedding AS b FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1), e AS (SELECT vec_id, unnest(a)::DOUBLE AS x, unnest(b)::DOUBLE AS y FROM p)"


def _pairs(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings").select("vec_id", F.col("embedding").alias("a"))
    return e.join(e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("a").alias("b")), "vec_id")


def _measured(spark: SparkSession, d: str, **made: Column) -> DataFrame:
    return _pairs(spark, d).select("vec_id", *(F.round(c, 4).alias(n) for n, c in made.items()))


A, B = (lambda: F.col("a")), (lambda: F.col("b"))


@query(f"{PAIR} SELECT vec_id, round(sum(abs(x - y)), 4) AS l1, round(sum((x - y) * (x - y)), 4) AS l2sq, round(sqrt(sum((x - y) * (x - y))), 4) AS l2, round(max(abs(x - y)), 4) AS linf, round(sum(pow(abs(x - y), 3)), 4) AS minkowski3 FROM e GROUP BY 1")
def vector_distances(spark: SparkSession, d: str) -> DataFrame:
    a, b = A(), B()
    return _measured(spark, d, l1=v.l1(a, b), l2sq=v.l2_squared(a, b), l2=v.l2(a, b), linf=v.linf(a, b), minkowski3=v.minkowski(a, b, 3))


@query(f"{PAIR} SELECT vec_id, round(sum(x * y), 4) AS dot, round(sum(x * y) / sqrt(sum(x * x) * sum(y * y)), 4) AS cosine, round(sum(least(abs(x), abs(y))), 4) AS intersection, round(sum(CASE WHEN abs(x) + abs(y) > 0 THEN (abs(x) - abs(y)) * (abs(x) - abs(y)) / (abs(x) + abs(y)) ELSE 0 END), 4) AS chi_square, round(sum((sqrt(abs(x)) - sqrt(abs(y))) * (sqrt(abs(x)) - sqrt(abs(y)))), 4) AS hellinger FROM e GROUP BY 1")
def histogram_distances(spark: SparkSession, d: str) -> DataFrame:
    a, b = A(), B()
    pa, pb = (F.transform(c, lambda x: F.abs(x.cast("double"))) for c in (a, b))
    return _measured(spark, d, dot=v.dot(a, b), cosine=v.cosine(a, b), intersection=v.histogram_intersection(pa, pb), chi_square=v.chi_square(pa, pb), hellinger=v.hellinger(pa, pb))


@query(f"{PAIR} SELECT vec_id, round(sum(CASE WHEN x > 0 AND y > 0 THEN x * ln(x / y) ELSE 0 END), 3) AS kl, round(sum(sqrt(abs(x - y))), 3) AS sublinear, round(sqrt(sum(abs(2 * x - 3 * y))), 3) AS pf, round(sum(abs(2 * x - 3 * y)), 3) AS k FROM e GROUP BY 1")
def divergences(spark: SparkSession, d: str) -> DataFrame:
    a, b = A(), B()
    made = {"kl": v.kl(a, b), "sublinear": v.sublinear(a, b), "pf": v.pf(a, b, 2, 3), "k": v.k_norm(a, b, 2, 3)}
    return _pairs(spark, d).select("vec_id", *(F.round(c, 3).alias(n) for n, c in made.items()))


@query(f"{PAIR}, p2 AS (SELECT vec_id, abs(x) AS x, abs(y) AS y FROM e) SELECT vec_id, round(sqrt(sum((sqrt(x) - sqrt(y)) * (sqrt(x) - sqrt(y)))), 4) AS jm, round(CASE WHEN sum(sqrt(x * y)) > 0 THEN -ln(sum(sqrt(x * y))) ELSE 0 END, 4) AS bhattacharyya, round(sum(CASE WHEN x > 0 AND y > 0 THEN (x / y - 1) * ln(x / y) ELSE 0 END), 2) AS div, round(sum(CASE WHEN x + y <> 0 THEN (x - y) * (x - y) / (x + y) ELSE 0 END), 4) AS cs FROM p2 GROUP BY 1")
def histogram_norms(spark: SparkSession, d: str) -> DataFrame:
    a, b = (F.transform(c, lambda x: F.abs(x.cast("double"))) for c in (A(), B()))
    p = _pairs(spark, d)
    return p.select("vec_id", F.round(v.jm(a, b), 4).alias("jm"), F.round(v.bhattacharyya(a, b), 4).alias("bhattacharyya"), F.round(v.div(a, b), 2).alias("div"), F.round(v.cs(a, b), 4).alias("cs"))


@query("SELECT o_orderkey, bit_count(xor(o_orderkey * 7919, o_custkey * 104729))::INT AS hamming FROM orders")
def hamming_distance(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").select("o_orderkey", v.hamming(F.col("o_orderkey") * 7919, F.col("o_custkey") * 104729).alias("hamming"))


@query("WITH q AS (SELECT vec_id AS query_id, embedding AS q FROM embeddings WHERE vec_id % 20 = 0), s AS (SELECT query_id, vec_id, list_sum(list_transform(list_zip(q, embedding), lambda t: (t[1]::DOUBLE - t[2]::DOUBLE) * (t[1]::DOUBLE - t[2]::DOUBLE))) AS d2 FROM q, embeddings) SELECT query_id, vec_id, round(d2, 4) AS d2 FROM s QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY d2, vec_id) <= 5")
def vector_knn_exact(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings")
    return ann.exact_knn(e, e.filter("vec_id % 20 = 0"), 5).select("query_id", "vec_id", F.round("d2", 4).alias("d2"))


@query("WITH q AS (SELECT vec_id AS query_id, embedding AS q FROM embeddings WHERE vec_id % 20 = 0), s AS (SELECT query_id, vec_id, list_sum(list_transform(list_zip(q, embedding), lambda t: (t[1]::DOUBLE - t[2]::DOUBLE) * (t[1]::DOUBLE - t[2]::DOUBLE))) AS d2 FROM q, embeddings) SELECT query_id, vec_id, round(d2, 4) AS d2 FROM s WHERE d2 < 1.44")
def vector_radius(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings")
    return ann.within(e, e.filter("vec_id % 20 = 0"), 1.2).select("query_id", "vec_id", F.round("d2", 4).alias("d2"))


@query()
def vector_knn_lsh(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings")
    return ann.lsh_knn(e, e.filter("vec_id % 20 = 0"), 5)


@query()
def vector_knn_ivf(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings")
    return ann.tree_knn(e, e.filter("vec_id % 20 = 0"), 5)


@query("SELECT event_id, round(degrees(value), 6) AS degrees, round(radians(value), 6) AS radians, round(value - floor((value + pi()) / (2 * pi())) * (2 * pi()), 6) AS wrapped FROM events")
def angle_functions(spark: SparkSession, d: str) -> DataFrame:
    c = F.col("value")
    return table(spark, d, "events").select("event_id", F.round(F.degrees(c), 6).alias("degrees"), F.round(F.radians(c), 6).alias("radians"), F.round(g.normalised_angle(c), 6).alias("wrapped"))


@query(f"WITH {POINTS}, d AS (SELECT point_id, x - 500 AS wx, y - 500 AS wy, z - 500 AS wz FROM points) SELECT point_id, round(((2 * wz - 3 * wy) * (2 * wz - 3 * wy) + (3 * wx - 1 * wz) * (3 * wx - 1 * wz) + (1 * wy - 2 * wx) * (1 * wy - 2 * wx)) / 14, 4) AS d2 FROM d")
def point_line_distance(spark: SparkSession, d: str) -> DataFrame:
    lit = lambda *v: tuple(F.lit(float(x)) for x in v)
    return points(spark, d).select("point_id", F.round(g.point_line2(g.vec(), lit(500, 500, 500), lit(1, 2, 3)), 4).alias("d2"))


@query(f"WITH {POINTS} SELECT point_id, round(-(0.6 * x + 0.8 * z - 700) / 0.8, 4) AS t FROM points")
def plane_line_intersection(spark: SparkSession, d: str) -> DataFrame:
    lit = lambda *v: tuple(F.lit(float(x)) for x in v)
    return points(spark, d).select("point_id", F.round(g.plane_line(g.vec(), lit(0, 0, 1), lit(0.6, 0, 0.8), F.lit(-700.0)), 4).alias("t"))


@query(f"WITH {POINTS} SELECT point_id, round(-y, 4) AS x, round(x, 4) AS y, z FROM points")
def quaternion_rotation(spark: SparkSession, d: str) -> DataFrame:
    h = 0.5**0.5
    x, y, z = g.quaternion_rotated(tuple(F.lit(q) for q in (h, 0.0, 0.0, h)), g.vec())
    return points(spark, d).select("point_id", F.round(x, 4).alias("x"), F.round(y, 4).alias("y"), F.round(z, 4).alias("z"))


@query("SELECT label, count(*) AS n FROM embeddings GROUP BY 1")
def vector_labels(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").groupBy("label").agg(F.count(F.lit(1)).alias("n"))


@query()
def vector_clusters(spark: SparkSession, d: str) -> DataFrame:
    return ann.kmeans_assign(table(spark, d, "embeddings"), 8)


STOPS = [(0, 0, 0, 64), (600, 0, 128, 255), (1400, 255, 200, 0), (2200, 255, 255, 255)]


def _ramp(k: int) -> str:
    parts = [f"WHEN gray < {STOPS[0][0]} THEN {STOPS[0][k]}"] + [f"WHEN gray < {b[0]} THEN {a[k]} + (gray - {a[0]}) * ({b[k] - a[k]}) / {b[0] - a[0]}.0" for a, b in zip(STOPS, STOPS[1:])]
    return f"round(CASE {' '.join(parts)} ELSE {STOPS[-1][k]} END::DOUBLE, 6)"


@query(f"WITH {VOLUME} SELECT x, y, z, {_ramp(1)} AS red, {_ramp(2)} AS green, {_ramp(3)} AS blue FROM volume")
def colour_mapped(spark: SparkSession, d: str) -> DataFrame:
    red, green, blue = (F.round(c, 6) for c in colour.mapped(F.col("gray"), STOPS))
    return volume(spark, d).select("x", "y", "z", red.alias("red"), green.alias("green"), blue.alias("blue"))


@query(f"WITH {POINTS}, a AS (SELECT point_id, x, y * cos(0.3) - z * sin(0.3) AS y, y * sin(0.3) + z * cos(0.3) AS z FROM points), b AS (SELECT point_id, x * cos(0.5) + z * sin(0.5) AS x, y, z * cos(0.5) - x * sin(0.5) AS z FROM a) SELECT point_id, round(x * cos(0.7) - y * sin(0.7), 4) AS x, round(x * sin(0.7) + y * cos(0.7), 4) AS y, round(z, 4) AS z FROM b")
def euler_rotation(spark: SparkSession, d: str) -> DataFrame:
    x, y, z = g.euler_rotated(tuple(F.lit(a) for a in (0.3, 0.5, 0.7)), g.vec())
    return points(spark, d).select("point_id", F.round(x, 4).alias("x"), F.round(y, 4).alias("y"), F.round(z, 4).alias("z"))


@query("SELECT o_orderkey, (year(DATE '2024-02-29') - year(o_orderdate) - (month(o_orderdate) * 100 + day(o_orderdate) > 229)::INT)::INT AS age FROM orders")
def ages(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").select("o_orderkey", time.age(F.col("o_orderdate"), F.lit("2024-02-29").cast("date")).cast("int").alias("age"))


@query(f"WITH {POINTS}, w AS (SELECT point_id, x - 500 AS wx, y - 480 AS wy, z - 450 AS wz FROM points), l AS (SELECT point_id, 0.6 * wx + 0.8 * wz AS h, wx * wx + wy * wy + wz * wz AS w2, sqrt((0.8 * wy) * (0.8 * wy) + (0.6 * wz - 0.8 * wx) * (0.6 * wz - 0.8 * wx) + (0.6 * wy) * (0.6 * wy)) AS line FROM w) SELECT point_id, round(line, 4) AS line, round(line - 200, 4) AS cylinder, round(sqrt((sqrt(greatest(w2 - h * h, 0)) - 200) ^ 2 + h * h), 4) AS circle, round(sqrt(w2) - 200, 4) AS sphere FROM l")
def model_residuals(spark: SparkSession, d: str) -> DataFrame:
    model = {"px": 500.0, "py": 480.0, "pz": 450.0, "dx": 0.6, "dy": 0.0, "dz": 0.8, "r": 200.0, "cx": 500.0, "cy": 480.0, "cz": 450.0}
    p = points(spark, d).withColumns({c: F.lit(v) for c, v in model.items()})
    kinds = {"line": fit.line_residual(), "cylinder": fit.cylinder_residual(), "circle": fit.circle_residual(), "sphere": fit.sphere_residual()}
    return p.select("point_id", *(F.round(r, 4).alias(n) for n, r in kinds.items()))


@query()
def adaptive_ransac_plane(spark: SparkSession, d: str) -> DataFrame:
    return fit.adaptive_plane(points(spark, d), 20.5, batch=64, most=256)
