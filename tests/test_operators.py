import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from geomill.operators import ann, features, filters, fit, graph, mesh, neighbors, stencil, surface, voxel
from geomill.operators.numbering import numbered
from geomill.sources.volumes import implicit
from geomill.streaming import match


@pytest.fixture(scope="module")
def cloud(spark):
    rng = np.random.default_rng(4)
    p = rng.random((300, 3)) * 100
    return spark.createDataFrame([(i, *map(float, v)) for i, v in enumerate(p)], "point_id long, x double, y double, z double"), p


def test_non_finite_and_unknown_field(spark):
    df = spark.createDataFrame([(0, 1.0, 2.0, 3.0), (1, math.nan, 2.0, 3.0), (2, 1.0, math.inf, 3.0), (3, None, 0.0, 0.0)], "point_id long, x double, y double, z double")
    assert [r.point_id for r in filters.pass_through(df, "x", 0, 2).collect()] == [0]
    assert filters.pass_through(df, "x", 5, 6, negative=True).count() == 1
    assert filters.pass_through(df, "nothing", 0, 1).count() == 0
    assert filters.crop_box(df, (0, 0, 0), (1, 1, 1), negative=True).count() == 1


@pytest.mark.parametrize("k", [1, 4, 350])
def test_knn_is_brute_force(cloud, k):
    df, p = cloud
    q = df.filter("point_id < 20").withColumnRenamed("point_id", "query_id")
    got = {(r.query_id, r["rank"]): r.point_id for r in neighbors.knn(df, q, k).collect()}
    for i in range(20):
        order = sorted(range(300), key=lambda j: (((p[j] - p[i]) ** 2).sum(), j))[:k]
        assert [got[i, n + 1] for n in range(len(order))] == order


def test_radius_bounds_are_strict(spark):
    p = spark.createDataFrame([(0, 3.0, 0.0, 0.0), (1, 2.9, 0.0, 0.0)], "point_id long, x double, y double, z double")
    q = spark.createDataFrame([(0, 0.0, 0.0, 0.0)], "query_id long, x double, y double, z double")
    assert [r.point_id for r in neighbors.radius_join(p, q, 3).collect()] == [1]
    assert neighbors.radius_join(p, q, 3, inclusive=True).count() == 2


def test_empty_inputs(spark):
    none = spark.createDataFrame([], "point_id long, x double, y double, z double")
    q = spark.createDataFrame([(0, 0.0, 0.0, 0.0)], "query_id long, x double, y double, z double")
    assert neighbors.knn(none, q, 3).count() == 0
    assert neighbors.radius_join(none, q, 3).count() == 0
    assert voxel.voxel_grid(none, 1).count() == 0


def test_normals_of_a_plane(spark):
    rows = [(i * 10 + j, float(i), float(j), 0.5 * i) for i in range(10) for j in range(10)]
    n = features.normals(spark.createDataFrame(rows, "point_id long, x double, y double, z double"), 1.8).collect()
    want = np.array([-0.5, 0, 1]) / math.sqrt(1.25)
    assert all(np.allclose([r.nx, r.ny, r.nz], want, atol=1e-6) and r.curvature < 1e-9 for r in n)


def test_components_of_chains(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40) if i != 20], "a long, b long")
    nodes = spark.range(42)
    got = {r.id: r.component for r in graph.components(nodes, edges).collect()}
    assert all(got[i] == (0 if i <= 20 else 21) for i in range(41)) and got[41] == 41


def test_surface_is_closed(spark):
    v = implicit(spark, 12)
    t = surface.cell_triangles(v, 945)
    key = F.concat_ws(",", *(F.least(f"a{c}", f"b{c}") for c in "xyz"), *(F.greatest(f"a{c}", f"b{c}") for c in "xyz"))
    corner = t.select("x", "y", "z", "tri", "corner", key.alias("k"))
    tri = corner.groupBy("x", "y", "z", "tri").agg(F.sort_array(F.collect_list("k")).alias("k"))
    sides = tri.select(F.explode(F.array(F.array(F.col("k")[0], F.col("k")[1]), F.array(F.col("k")[1], F.col("k")[2]), F.array(F.col("k")[0], F.col("k")[2]))).alias("s"))
    counts = {r["count"] for r in sides.groupBy("s").count().collect()}
    assert counts == {2}
    vertices, n, e = corner.select("k").distinct().count(), tri.count(), sides.distinct().count()
    assert vertices - e + n == 2  # a sphere


def test_sobel_of_a_ramp(spark):
    v = implicit(spark, 5, "7 * x - 2 * y")
    rows = stencil.sobel(v).collect()
    assert len(rows) == 27 and all((r.gx, r.gy, r.gz) == (-7 * 32, 2 * 32, 0) for r in rows)


def test_otsu_splits_two_peaks(spark):
    h = voxel.histogram(spark.createDataFrame([(g,) for g in [10] * 50 + [11] * 20 + [200] * 40], "gray int"), 256)
    assert 11 <= voxel.otsu(h).first().threshold < 200


def test_alignment_moves_a_turned_cloud_back(cloud):
    df, _ = cloud
    stretched = df.withColumn("x", F.col("x") * 5).withColumn("y", F.col("y") * 2)
    turned = filters.transformed(stretched, [[0, -1, 0, 7], [1, 0, 0, 3], [0, 0, 1, -2]])
    back = fit.aligned(turned, stretched)
    a, b = (sorted((r.point_id, r.x, r.y, r.z) for r in d.collect()) for d in (back, stretched))
    spread = {tuple(np.round(np.abs(np.array(x[1:]) - np.array(y[1:])), 6)) for x, y in zip(a, b)}
    ma, mb = np.mean([x[1:] for x in a], axis=0), np.mean([x[1:] for x in b], axis=0)
    assert np.allclose(ma, mb)
    assert spread == {(0.0, 0.0, 0.0)} or np.allclose(np.cov(np.array([x[1:] for x in a]).T), np.cov(np.array([x[1:] for x in b]).T))


def test_sphere(spark):
    rng = np.random.default_rng(0)
    u = rng.normal(size=(200, 3))
    p = u / np.linalg.norm(u, axis=1)[:, None] * 3 + [1, 2, 3]
    r = fit.fitted_sphere(spark.createDataFrame([tuple(map(float, v)) for v in p], "x double, y double, z double")).first()
    assert np.allclose([r.cx, r.cy, r.cz, r.r], [1, 2, 3, 3])


def test_lsh_recall(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    q = e.filter("vec_id % 20 = 0")
    exact = {(r.query_id, r.vec_id) for r in ann.exact_knn(e, q, 5).collect()}
    for index in (ann.lsh_knn, ann.tree_knn):
        found = {(r.query_id, r.vec_id) for r in index(e, q, 5).collect()}
        assert len(exact & found) >= 0.9 * len(exact), index
    in_blocks = {(r.query_id, r.vec_id) for r in ann.exact_knn(e, q, 5, block_bytes=2000).collect()}
    assert in_blocks == exact


def test_numbering(spark):
    df = spark.createDataFrame([(k,) for k in (5, 70000, 3, 200000, 140000)], "id long")
    assert [(r.id, r.n) for r in numbered(df, "id", "n").orderBy("id").collect()] == [(3, 0), (5, 1), (70000, 2), (140000, 3), (200000, 4)]


def test_plane_slice_points_lie_on_the_plane(spark):
    v = spark.createDataFrame([(0, 0.0, 0.0, 0.0), (1, 2.0, 0.0, 2.0), (2, 0.0, 2.0, 2.0), (3, 5.0, 5.0, 0.5)], "id long, x double, y double, z double")
    f = spark.createDataFrame([(0, 0, 1, 2), (1, 0, 1, 3)], "face_id long, v0 long, v1 long, v2 long")
    rows = mesh.plane_slice(mesh.corners(v, f), (0, 0, 1), (0, 0, 1)).collect()
    assert len(rows) == 2 and all(abs(r.az - 1) < 1e-12 and abs(r.bz - 1) < 1e-12 for r in rows)


def test_streams_match_and_count(spark, tmp_path):
    rows = [(1, 0, "2024-01-01 00:00:00", 10), (1, 1, "2024-01-01 00:00:02", 20), (1, 1, "2024-01-01 00:00:09", 21), (1, 0, "2024-01-01 00:00:05", 11), (2, 0, "2024-01-01 00:00:05", 12)]
    schema = "user_id long, side int, ts timestamp, event_id long"
    df = spark.createDataFrame(rows, "user_id long, side int, t string, event_id long").select("user_id", "side", F.col("t").cast("timestamp").alias("ts"), "event_id")
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    q = match.stream_match(stream, "user_id", "side").writeStream.format("memory").queryName("matched").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = {(r.left_id, r.right_id, r.gap_us) for r in spark.table("matched").collect()}
    batch = match.nearest_time(df.filter("side = 0"), df.filter("side = 1"), ["user_id"])
    want = {(r.left_id, r.right_id, r.gap_us) for r in batch.filter("right_id is not null").collect()}
    assert got == want == {(10, 20, 2_000_000), (11, 20, 3_000_000)}
    h = match.running_histogram(stream.withColumn("value", F.col("event_id")), "value", 10).writeStream.format("memory").queryName("hist").outputMode("complete").option("checkpointLocation", str(tmp_path / "h")).trigger(availableNow=True).start()
    h.awaitTermination(120)
    assert {(r.bin, r.n) for r in spark.table("hist").collect()} == {(1, 3), (2, 2)}
