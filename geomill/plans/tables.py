"""Clouds, volumes and meshes derived from the given tables, in Spark and in SQL by the same formulas.

Keys of the tables are consecutive, so a key is a raster index: volumes and meshes grow
with their table. Coordinates are whole numbers held as doubles, exact in both engines.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _d(c: Column) -> Column:
    return c.cast("double")


def _hash(key: str, factor: int, mod: int) -> Column:
    return _d((F.col(key) * factor) % mod)


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(point_id, x, y, z, v): one point for each order in a cube of side 1000."""
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("point_id"), _hash("o_orderkey", 7919, 997).alias("x"), _hash("o_orderkey", 104729, 991).alias("y"), _d(F.floor("o_totalprice") % 1000).alias("z"), _d(F.floor("o_totalprice") % 4096).alias("v"))


POINTS = "points AS (SELECT o_orderkey AS point_id, ((o_orderkey * 7919) % 997)::DOUBLE AS x, ((o_orderkey * 104729) % 991)::DOUBLE AS y, (floor(o_totalprice)::BIGINT % 1000)::DOUBLE AS z, (floor(o_totalprice)::BIGINT % 4096)::DOUBLE AS v FROM orders)"


def cloud(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(point_id, x, y, z, v): one point for each part in a cube of side 500."""
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("point_id"), _hash("p_partkey", 7919, 499).alias("x"), _hash("p_partkey", 104729, 491).alias("y"), _d(F.floor(F.col("p_retailprice") * 10) % 500).alias("z"), _d(F.col("p_size")).alias("v"))


CLOUD = "cloud AS (SELECT p_partkey AS point_id, ((p_partkey * 7919) % 499)::DOUBLE AS x, ((p_partkey * 104729) % 491)::DOUBLE AS y, (floor(p_retailprice * 10)::BIGINT % 500)::DOUBLE AS z, p_size::DOUBLE AS v FROM part)"


def queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(query_id, x, y, z, radius): one query for each customer, radii from 10 to 50."""
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("query_id"), _hash("c_custkey", 6151, 997).alias("x"), _hash("c_custkey", 3571, 991).alias("y"), _hash("c_custkey", 2971, 1000).alias("z"), (_hash("c_custkey", 17, 41) + 10).alias("radius"))


QUERIES = "queries AS (SELECT c_custkey AS query_id, ((c_custkey * 6151) % 997)::DOUBLE AS x, ((c_custkey * 3571) % 991)::DOUBLE AS y, ((c_custkey * 2971) % 1000)::DOUBLE AS z, (((c_custkey * 17) % 41) + 10)::DOUBLE AS radius FROM customer)"

#: Raster of the volume: x runs fastest, z grows with the table.
WIDTH, HEIGHT = 32, 32


def volume(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(x, y, z, gray): one voxel for each order; gray rises along x and carries noise from the price."""
    k = F.col("o_orderkey")
    x, y, z = (k % WIDTH), F.floor(k / WIDTH) % HEIGHT, F.floor(k / (WIDTH * HEIGHT))
    return table(spark, sf_dir, "orders").select(*(c.cast("int").alias(n) for n, c in (("x", x), ("y", y), ("z", z))), (F.floor("o_totalprice") % 1000 + 40 * (k % WIDTH)).cast("int").alias("gray"))


VOLUME = f"volume AS (SELECT (o_orderkey % {WIDTH})::INT AS x, ((o_orderkey // {WIDTH}) % {HEIGHT})::INT AS y, (o_orderkey // {WIDTH * HEIGHT})::INT AS z, (floor(o_totalprice)::BIGINT % 1000 + 40 * (o_orderkey % {WIDTH}))::INT AS gray FROM orders)"

#: Slices of the volume.
DEPTH = f"dims AS (SELECT (max(o_orderkey) // {WIDTH * HEIGHT} + 1)::BIGINT AS depth FROM orders)"


def depth(spark: SparkSession, sf_dir: str) -> int:
    return (table(spark, sf_dir, "orders").agg(F.max("o_orderkey")).first()[0] or 0) // (WIDTH * HEIGHT) + 1


#: Vertices in a row of the height field.
ROW = 50


def vertices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, x, y, z): a height field with one vertex for each order."""
    k = F.col("o_orderkey")
    return table(spark, sf_dir, "orders").select(k.alias("id"), _d(k % ROW).alias("x"), _d(F.floor(k / ROW)).alias("y"), _d(F.floor("o_totalprice") % 20).alias("z"))


def faces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(face_id, v0, v1, v2): two triangles for each full cell of the height field."""
    k = F.col("o_orderkey")
    orders = table(spark, sf_dir, "orders").select(k)
    last = orders.agg(F.max(k).alias("last"))
    cells = orders.join(F.broadcast(last), (k % ROW < ROW - 1) & (k + ROW + 1 <= F.col("last")))
    pair = F.array(F.struct((2 * k).alias("face_id"), k.alias("v0"), (k + 1).alias("v1"), (k + ROW).alias("v2")), F.struct((2 * k + 1).alias("face_id"), (k + 1).alias("v0"), (k + ROW + 1).alias("v1"), (k + ROW).alias("v2")))
    return cells.select(F.inline(pair))


def rows(spark: SparkSession, sf_dir: str) -> int:
    """Rows of the height field."""
    return (table(spark, sf_dir, "orders").agg(F.max("o_orderkey")).first()[0] or 0) // ROW


ROWS = f"field AS (SELECT (max(o_orderkey) // {ROW})::BIGINT AS n FROM orders)"


def high_faces(spark: SparkSession, sf_dir: str, least: float) -> DataFrame:
    """The faces whose corners all stand at z >= least: islands all over the mesh."""
    tri = corners(vertices(spark, sf_dir), faces(spark, sf_dir))
    return tri.filter(F.least("z0", "z1", "z2") >= least).select("face_id", "v0", "v1", "v2")


MESH = f"""vertices AS (SELECT o_orderkey AS id, (o_orderkey % {ROW})::DOUBLE AS x, (o_orderkey // {ROW})::DOUBLE AS y, (floor(o_totalprice)::BIGINT % 20)::DOUBLE AS z FROM orders),
faces AS (SELECT 2 * o_orderkey AS face_id, o_orderkey AS v0, o_orderkey + 1 AS v1, o_orderkey + {ROW} AS v2 FROM orders WHERE o_orderkey % {ROW} < {ROW - 1} AND o_orderkey + {ROW + 1} <= (SELECT max(o_orderkey) FROM orders)
UNION ALL SELECT 2 * o_orderkey + 1, o_orderkey + 1, o_orderkey + {ROW + 1}, o_orderkey + {ROW} FROM orders WHERE o_orderkey % {ROW} < {ROW - 1} AND o_orderkey + {ROW + 1} <= (SELECT max(o_orderkey) FROM orders))"""


def corners(vertices: DataFrame, faces: DataFrame) -> DataFrame:
    """Faces with the coordinates of their corners (x0, y0, z0, x1, ...)."""
    out = faces
    for i in range(3):
        out = out.join(vertices.select(F.col("id").alias(f"v{i}"), *(F.col(c).alias(f"{c}{i}") for c in "xyz")), f"v{i}")
    return out


CORNERS = "corners AS (SELECT f.*, a.x AS x0, a.y AS y0, a.z AS z0, b.x AS x1, b.y AS y1, b.z AS z1, c.x AS x2, c.y AS y2, c.z AS z2 FROM faces f JOIN vertices a ON a.id = v0 JOIN vertices b ON b.id = v1 JOIN vertices c ON c.id = v2)"
