"""Nothing is capped in silence: long rays, wide codes, long chains, points without a place, hot groups."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from geomill.functions import colour
from geomill.functions import geometry as g
from geomill.functions.time import age
from geomill.operators import ann, fit, graph, mesh, neighbors, numbering, rays, surface, voxel
from geomill.sources import volumes
from geomill.streaming import match

POINTS = "point_id long, x double, y double, z double"


def _walk(a, b):
    """Voxels of a segment by plain sorting of its crossings."""
    t = {0.0, 1.0}
    for u, v in zip(a, b):
        if u != v:
            t |= {(k - u) / (v - u) for k in range(math.floor(min(u, v)) + 1, math.ceil(max(u, v)))}
    t = sorted(t)
    return [tuple(math.floor(u + (p + q) / 2 * (v - u)) for u, v in zip(a, b)) for p, q in zip(t, t[1:])]


@pytest.mark.parametrize("piece", [4, 7, 1024])
def test_long_rays_lose_no_voxel(spark, piece):
    ends = [((0.5, 0.5, 0.5), (5001.5, 0.5, 0.5)), ((-3.25, 7.5, 2.0), (40.75, -20.125, 9.5)), ((1.5, 1.5, 1.5), (1.5, 1.5, 1.5)), ((10.0, 0.0, 0.0), (0.0, 10.0, 10.0))]
    ends = ends if piece == 1024 else ends[1:]
    df = spark.createDataFrame([(i, *a, *b) for i, (a, b) in enumerate(ends)], "ray_id int, ax double, ay double, az double, bx double, by double, bz double")
    got = {}
    for r in sorted(rays.traversed(df, piece).collect(), key=lambda r: (r.ray_id, r.nth)):
        got.setdefault(r.ray_id, []).append((r.x, r.y, r.z))
    assert got == {i: _walk(a, b) for i, (a, b) in enumerate(ends)}
    if piece == 1024:
        assert len(got[0]) == 5002


def test_morton_codes(spark):
    rng = np.random.default_rng(1)
    rows = [(1024, 1024, 1024), (2097151, 0, 2097151), *map(lambda v: tuple(map(int, v)), rng.integers(0, 1 << 21, (50, 3)))]
    df = spark.createDataFrame(rows, "x long, y long, z long")
    got = {(r.x, r.y, r.z): r.m for r in df.withColumn("m", voxel.morton("x", "y", "z")).collect()}
    assert got == {p: sum((v >> b & 1) << 3 * b + i for i, v in enumerate(p) for b in range(21)) for p in rows}
    for bad in ((1 << 21, 0, 0), (0, -1, 0)):
        with pytest.raises(Exception, match="Morton"):
            spark.createDataFrame([bad], "x long, y long, z long").select(voxel.morton("x", "y", "z")).collect()
    p = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(rows)], POINTS)
    assert [r.morton for r in voxel.morton_sorted(p).collect()] == sorted(got[r] for r in rows)


def test_points_without_a_place(spark):
    rng = np.random.default_rng(2)
    p = [(i, *map(float, v)) for i, v in enumerate(rng.random((20, 3)) * 10)]
    odd = [(100, math.nan, 1.0, 1.0), (101, 1.0, math.inf, 1.0), (102, None, 1.0, 1.0)]
    df, whole = spark.createDataFrame(p + odd, POINTS), spark.createDataFrame(p, POINTS)
    near = neighbors.knn(df, df.withColumnRenamed("point_id", "query_id"), 3).collect()
    assert sorted(map(tuple, near)) == sorted(map(tuple, neighbors.knn(whole, whole.withColumnRenamed("point_id", "query_id"), 3).collect()))
    kept = {r.point_id for r in neighbors.statistical_inliers(df, 3, 0.5).collect()}
    assert kept == {r.point_id for r in neighbors.statistical_inliers(whole, 3, 0.5).collect()} | {100, 101, 102}
    assert neighbors.approximate_nearest(df, df.withColumnRenamed("point_id", "query_id"), 2.0).count() == 20


def test_every_query_has_an_approximate_neighbour(spark):
    p = spark.createDataFrame([(1, 5.0, 5.0, 5.0), (2, 6.0, 5.0, 5.0), (3, -900.0, 3.0, 3.0)], POINTS)
    q = spark.createDataFrame([(1, 5.4, 5.0, 5.0), (2, 70.0, 5.0, 5.0), (3, -850.0, 0.0, 0.0), (4, 1e6, -1e6, 7.0)], "query_id long, x double, y double, z double")
    got = {r.query_id: r.point_id for r in neighbors.approximate_nearest(p, q, 10.0).collect()}
    assert got[1] == 1 and got[2] == 1 and got[3] == 3 and set(got) == {1, 2, 3, 4}
    assert neighbors.approximate_nearest(p.limit(0), q, 10.0).count() == 0


def test_long_chains_are_one_component(spark):
    edges = spark.range(3000).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    got = graph.components(spark.range(3005), edges).collect()
    assert {r.component for r in got} == {0, *range(3001, 3005)}
    assert graph.components(spark.range(3), edges.limit(0)).count() == 3


def test_header_after_many_lines(spark, tmp_path):
    (tmp_path / "v.raw").write_bytes(np.arange(8, dtype="<u2").tobytes())
    (tmp_path / "v.vgi").write_text("".join(f"key{i} = {i}\n" for i in range(3000)) + "Size = 2 2 2\nresolution = 0.5 0.5 0.5\n")
    df, step = volumes.read_vgi(spark, str(tmp_path / "v.vgi"), str(tmp_path / "v.raw"))
    assert df.count() == 8 and step == 0.5


@pytest.mark.parametrize("n", [1, 2, 7, 1000, 1001])
def test_median_penalty(spark, n):
    rng = np.random.default_rng(n)
    v = np.where(rng.random(n) < 0.3, 4.0, rng.normal(size=n) * rng.choice([1e-3, 1, 1e6], n))
    p = spark.createDataFrame([(i, float(x), 0.0, 0.0) for i, x in enumerate(v)], POINTS)
    planes = spark.createDataFrame([(0, 1.0, 0.0, 0.0, 0.0), (1, 1.0, 0.0, 0.0, -4.0)], "model_id int, a double, b double, c double, d double")
    got = {r.model_id: r.penalty for r in fit.lmeds(p, planes, fit.plane_residual(), bins=8).collect()}
    assert got == {0: pytest.approx(np.median(np.sqrt(np.abs(v)))), 1: pytest.approx(np.median(np.sqrt(np.abs(v - 4))))}


@pytest.mark.parametrize("width", [3, 50, 1 << 16])
def test_numbers_through_ranges_of_ranges(spark, width):
    keys = sorted(set(np.random.default_rng(5).integers(-500, 5000, 400).tolist()))
    df = spark.createDataFrame([(k, k % 7) for k in keys], "k long, v long")
    assert {r.k: r.n for r in numbering.numbered(df, "k", "n", width).collect()} == {k: i for i, k in enumerate(keys)}
    upto = dict(zip(keys, np.cumsum([0, *(k % 7 for k in keys)]).tolist()))
    assert {r.k: r.s for r in numbering.exclusive_scan(df, "k", "v", "s", width).collect()} == upto


def test_slabs_of_time_change_nothing(spark):
    rng = np.random.default_rng(6)
    rows = [(i, int(rng.integers(0, 3)), int(t)) for i, t in enumerate(rng.integers(0, 5000, 300))]
    e = spark.createDataFrame(rows, "event_id long, user_id long, s long").withColumn("ts", F.timestamp_seconds("s"))
    left, right = e.filter("event_id % 3 = 0"), e.filter("event_id % 3 = 1")
    some = [sorted(map(tuple, match.nearest_time(left, right, ["user_id"], slab_us=s).collect())) for s in (10_000_000, 500_000_000, 1 << 60)]
    assert some[0] == some[1] == some[2] and len(some[0]) == left.count()
    some = [sorted(map(str, match.gaps(e, ["user_id"], slab_us=s).collect())) for s in (10_000_000, 1 << 60)]
    assert some[0] == some[1]


def _triangle_distance(p, a, b, c):
    """Least distance over a fine grid of the triangle's points, and its corners and sides."""
    s = np.linspace(0, 1, 201)
    u, v = (m.ravel() for m in np.meshgrid(s, s))
    ok = u + v <= 1 + 1e-12
    q = a + u[ok, None] * (b - a) + v[ok, None] * (c - a)
    return np.sqrt(((q - p) ** 2).sum(axis=1)).min()


def test_nearest_faces_are_brute_force(spark):
    rng = np.random.default_rng(8)
    tri = [(i, *map(float, (rng.random(3) * 10 + rng.normal(size=(3, 3))).ravel())) for i in range(30)]
    t = spark.createDataFrame(tri, "face_id long, " + ", ".join(f"{c}{i} double" for i in range(3) for c in "xyz"))
    pts = rng.random((25, 3)) * 10
    p = spark.createDataFrame([(i, *map(float, v)) for i, v in enumerate(pts)], POINTS)
    got = {r.point_id: r.distance for r in mesh.nearest_faces(t, p, 3.0).collect()}
    for i, v in enumerate(pts):
        want = min(_triangle_distance(v, *np.array(f[1:]).reshape(3, 3)) for f in tri)
        if want < 2.95:
            assert got[i] == pytest.approx(want, abs=0.05)
        elif want > 3.05:
            assert i not in got


def test_oblique_rays_are_brute_force(spark):
    rng = np.random.default_rng(9)
    tri = [(i, *map(float, (rng.random(3) * 10 + 2 * rng.normal(size=(3, 3))).ravel())) for i in range(60)]
    t = spark.createDataFrame(tri, "face_id long, " + ", ".join(f"{c}{i} double" for i in range(3) for c in "xyz"))
    o, d = rng.random((40, 3)) * 10, rng.normal(size=(40, 3))
    r = spark.createDataFrame([(i, *map(float, a), *map(float, b)) for i, (a, b) in enumerate(zip(o, d))], "ray_id long, ox double, oy double, oz double, dx double, dy double, dz double")
    got = {x.ray_id: (x.face_id, x.t) for x in mesh.oblique_ray_hits(t, r, 2.0, far=8.0).collect()}
    for i in range(40):
        best = None
        for f in tri:
            a, b, c = np.array(f[1:]).reshape(3, 3)
            m = np.stack([b - a, c - a, -d[i]], axis=1)
            u, v, s = np.linalg.solve(m, o[i] - a)
            if u >= 0 and v >= 0 and u + v <= 1 and 0 <= s <= 8 and (best is None or s < best[1]):
                best = (f[0], s)
        assert (i in got) == (best is not None)
        if best:
            assert got[i][0] == best[0] and got[i][1] == pytest.approx(best[1])


def test_signed_distances_are_brute_force(spark):
    v = spark.createDataFrame([(x, y, z, 100 * x + 10 * ((x * y + z) % 3)) for x in range(6) for y in range(5) for z in range(4)], "x int, y int, z int, gray int")
    at = surface.crossings(v, 250)
    places = np.array([[r.px, r.py, r.pz] for r in at.collect()], float)
    s = at.select(F.xxhash64("axis", "x", "y", "z").alias("point_id"), *(F.col(f"p{c}").cast("double").alias(c) for c in "xyz"))
    q = v.select((F.col("x") + 6 * F.col("y") + 30 * F.col("z").cast("long")).alias("query_id"), *(F.col(c).cast("double").alias(c) for c in "xyz"), "gray")
    held = {r.query_id: r for r in q.collect()}
    for r in surface.signed_distance(s, q, 250).collect():
        own = held[r[0]]
        near = np.sort(np.sqrt(((places - [own.x, own.y, own.z]) ** 2).sum(axis=1)))[:3]
        assert abs(r[1]) == pytest.approx(near.mean())


@pytest.fixture(scope="module")
def normal_vectors(spark):
    rng = np.random.default_rng(3)
    e = spark.createDataFrame([(i, list(map(float, v))) for i, v in enumerate(rng.normal(size=(400, 16)))], "vec_id long, embedding array<float>")
    q = e.filter("vec_id % 20 = 0")
    return e, q, {(r.query_id, r.vec_id) for r in ann.exact_knn(e, q, 5).collect()}


@pytest.mark.parametrize("bits", [6, 10, 14])
def test_tables_keep_the_recall_as_bits_grow(normal_vectors, bits):
    e, q, exact = normal_vectors
    found = {(r.query_id, r.vec_id) for r in ann.lsh_knn(e, q, 5, bits=bits).collect()}
    assert len(exact & found) >= 0.9 * len(exact)


def test_more_bits_ask_for_more_tables():
    rng = np.random.default_rng(5)
    q = rng.normal(size=(50, 16))
    near = q + 0.4 * rng.normal(size=(50, 16))
    tables = [ann.tables_for(q, near, bits, 0.9, 1) for bits in (4, 8, 12)]
    assert tables[0] < tables[1] < tables[2]
    with pytest.raises(ValueError, match="fewer bits"):
        ann.tables_for(q, -q, 14, 0.9, 1)


def test_tree_reads_little_of_clustered_vectors(spark):
    rng = np.random.default_rng(8)
    middle = rng.normal(size=(60, 24)) * 4
    x = (middle[rng.integers(0, 60, 4000)] + rng.normal(size=(4000, 24))).astype(np.float32).astype(np.float64)
    e = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>").repartition(3)
    q = e.filter("vec_id % 20 = 0")
    exact = {(r.query_id, r.vec_id) for r in ann.exact_knn(e, q, 5).collect()}
    brute = {(i, int(j)) for i in range(0, 4000, 20) for j in np.lexsort((np.arange(4000), ((x - x[i]) ** 2).sum(axis=1)))[:5]}
    assert exact == brute
    found = {(r.query_id, r.vec_id) for r in ann.tree_knn(e, q, 5).collect()}
    assert len(exact & found) >= 0.9 * len(exact)
    tree = ann.CellTree(x[:2016], 63)
    pairs = [(i, j) for i, j in exact if i < 2000]
    probes = ann.probes_for(tree, x[[i for i, _ in pairs]], x[[j for _, j in pairs]], 0.93)
    size = np.bincount(tree.cell(x), minlength=len(tree.centres))
    assert size[tree.order(x[::20])[:, :probes]].sum(axis=1).mean() < 0.1 * len(x)


def test_best_is_brute_force_with_ties(monkeypatch):
    monkeypatch.setattr(ann, "PAIRS", 700)
    rng = np.random.default_rng(9)
    x, q = rng.integers(0, 3, (300, 4)).astype(float), rng.integers(0, 3, (20, 4)).astype(float)
    best = ann.Best(q, 7)
    for part in np.array_split(rng.permutation(300), 5):
        best.meet(np.arange(20), part, x[part])
    for i in range(20):
        d2 = ((x - q[i]) ** 2).sum(axis=1)
        want = np.lexsort((np.arange(300), d2))[:7]
        assert best.id[i].tolist() == want.tolist() and best.d2[i].tolist() == d2[want].tolist()


def test_levels_of_whole_tiles():
    assert voxel.level_dims((455, 485, 942)) == [(455, 485, 942), (227, 242, 471), (113, 121, 235), (56, 60, 117)]
    assert voxel.tiled_dims((455, 485, 942), 64)[0] == (512, 512, 960)


def test_adaptive_plane_stops_early(spark):
    rng = np.random.default_rng(4)
    p = rng.random((400, 3)) * 10
    p[:300, 2] = 5.0
    df = spark.createDataFrame([(i, *map(float, v)) for i, v in enumerate(p)], POINTS)
    best = fit.adaptive_plane(df, 0.01, batch=8).first()
    assert best.inliers >= 300 and abs(best.c) == pytest.approx(1, abs=1e-3)
    assert fit.trials(1.0, 3) == 1 and fit.trials(0.0, 3) == 4096 and fit.trials(0.5, 3) == 35


def test_angles_colours_and_ages(spark):
    angles = (0.3, -0.5, 0.7)
    h = [(math.cos(a / 2), math.sin(a / 2)) for a in angles]
    (cx, sx), (cy, sy), (cz, sz) = h
    q = (cx * cy * cz + sx * sy * sz, sx * cy * cz - cx * sy * sz, cx * sy * cz + sx * cy * sz, cx * cy * sz - sx * sy * cz)
    lit = lambda v: tuple(F.lit(float(x)) for x in v)
    one = spark.range(1).select(*g.euler_angles(lit(q)), *g.euler_rotated(lit(angles), lit((1, 2, 3))), *g.quaternion_rotated(lit(q), lit((1, 2, 3)))).first()
    assert one[:3] == pytest.approx(angles) and one[3:6] == pytest.approx(one[6:9])
    stops = [(0, 0, 0, 0), (10, 100, 50, 0), (20, 0, 255, 255)]
    v = spark.createDataFrame([(-5.0,), (5.0,), (10.0,), (15.0,), (30.0,), (None,)], "v double").select(*colour.mapped(F.col("v"), stops)).collect()
    assert [tuple(r) for r in v] == [(0, 0, 0), (50, 25, 0), (100, 50, 0), (50, 152.5, 127.5), (0, 255, 255), (None, None, None)]
    born = spark.sql("SELECT * FROM VALUES (DATE '2000-02-29', DATE '2001-02-28'), (DATE '2000-02-29', DATE '2001-03-01'), (DATE '1990-07-15', DATE '2020-07-15'), (DATE '1990-07-15', NULL) t(b, o)")
    assert [r[0] for r in born.select(age(F.col("b"), F.col("o"))).collect()] == [0, 1, 30, None]
