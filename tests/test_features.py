"""Features, samples and clusters that have no SQL, against plain loops."""

import math

import numpy as np
import pytest

from geomill.operators import ann, features, filters, fit

POINTS = "point_id long, x double, y double, z double"


@pytest.fixture(scope="module")
def cloud(spark):
    p = np.random.default_rng(12).uniform(0, 10, (120, 3))
    return spark.createDataFrame([(i, *map(float, v)) for i, v in enumerate(p)], POINTS).repartition(3), p


def _normal(p, i, radius):
    near = p[((p - p[i]) ** 2).sum(axis=1) <= radius * radius]
    if len(near) < 3:
        return np.full(3, np.nan)
    n = np.linalg.eigh(np.cov(near.T, bias=True))[1][:, 0]
    return -n if n[2] < 0 else n


def test_difference_of_normals(cloud):
    df, p = cloud
    got = {r.point_id: r for r in features.difference_of_normals(features.normals(df, 1.5), features.normals(df, 4.0)).collect()}
    assert len(got) == 120
    zero = 0
    for i in range(120):
        d = (_normal(p, i, 1.5) - _normal(p, i, 4.0)) / 2
        d = np.zeros(3) if np.isnan(d).any() else d
        zero += not d.any()
        assert [got[i].dx, got[i].dy, got[i].dz, got[i].norm] == pytest.approx([*d, np.linalg.norm(d)], abs=1e-6)
    assert 0 < zero < 120


def test_pair_features(cloud):
    df, p = cloud
    got = {(r.a, r.b): (r.f1, r.f2, r.f3, r.f4) for r in features.pair_features(df, features.normals(df, 4.0), 2.5).collect()}
    normal = [_normal(p, i, 4.0) for i in range(120)]
    want = {}
    for a in range(120):
        for b in range(120):
            d = p[b] - p[a]
            length = math.sqrt((d * d).sum())
            if a != b and length < 2.5:
                want[a, b] = (normal[a] @ d / length, normal[b] @ d / length, normal[a] @ normal[b], length)
    assert got.keys() == want.keys() and len(want) > 200
    assert all(got[k] == pytest.approx(want[k], abs=1e-6) for k in want)


@pytest.mark.parametrize("gap", [0.4, 1.5, 3.5])
def test_boundary_points(spark, gap):
    p = np.random.default_rng(13).uniform(0, 10, (250, 2))
    df = spark.createDataFrame([(i, float(x), float(y), 0.0) for i, (x, y) in enumerate(p)] + [(900, 99.0, 99.0, 0.0)], POINTS)
    got = {r.point_id: r.boundary for r in features.boundary_points(df, 1.8, gap).collect()}
    want = {900: False}
    for i in range(250):
        d = p - p[i]
        near = ((d * d).sum(axis=1) < 1.8 * 1.8) & (np.arange(250) != i)
        a = np.sort(np.arctan2(d[near, 1], d[near, 0]))
        want[i] = bool(len(a) >= 3 and np.diff(np.append(a, a[0] + 2 * np.pi)).max() > gap)
    assert got == want and len(set(want.values())) == 2


def test_vector_clusters(spark):
    x = np.random.default_rng(14).normal(size=(200, 6)).astype(np.float32).astype(float)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>").repartition(4)
    got = {r.vec_id: r.cluster for r in ann.kmeans_assign(df, 5, rounds=4).collect()}
    first = [r.vec_id for r in df.selectExpr("vec_id", "xxhash64(vec_id) AS h").orderBy("h", "vec_id").limit(5).collect()]
    c = x[first].copy()
    for _ in range(4):
        own = ((x[:, None] - c) ** 2).sum(axis=2).argmin(axis=1)
        c = np.array([x[own == k].mean(axis=0) if (own == k).any() else c[k] for k in range(5)])
    assert [got[i] for i in range(200)] == ((x[:, None] - c) ** 2).sum(axis=2).argmin(axis=1).tolist()


def test_random_subsample(cloud):
    df, _ = cloud
    pick = lambda frame, seed: [r.point_id for r in filters.subsample(frame, 30, seed).collect()]
    assert len(set(pick(df, 1))) == 30 and sorted(pick(df, 1)) == sorted(pick(df.repartition(7), 1))
    assert set(pick(df, 1)) != set(pick(df, 2))
    assert filters.subsample(df, 500).count() == 120
    # Halves of the ids are about evenly drawn.
    drawn = [i for seed in range(20) for i in pick(df, seed)]
    assert 230 < sum(i < 60 for i in drawn) < 370


def test_sampled_planes(cloud):
    df, p = cloud
    planes = {r.model_id: r for r in fit.planes_through(df, 12).collect()}
    order = [r.point_id for r in df.selectExpr("point_id", "xxhash64(point_id) AS h").orderBy("h", "point_id").limit(36).collect()]
    assert len(planes) == 12
    scores = {r.model_id: r for r in fit.score_models(df, fit.planes_through(df, 12), fit.plane_residual(), 0.8).collect()}
    for m, r in planes.items():
        a, b, c = p[order[3 * m : 3 * m + 3]]
        n = np.cross(b - a, c - a)
        off = np.abs((p - a) @ n) / np.linalg.norm(n)
        assert abs(r.a * r.a + r.b * r.b + r.c * r.c - 1) < 1e-9
        assert scores[m].inliers == (off < 0.8).sum() and scores[m].msac == pytest.approx(np.minimum(off, 0.8).sum())
    assert fit.best_model(fit.score_models(df, fit.planes_through(df, 12), fit.plane_residual(), 0.8)).first().inliers == max(s.inliers for s in scores.values())


def test_vectors_within_a_radius(spark):
    x = np.random.default_rng(15).normal(size=(150, 5)).astype(np.float32).astype(float)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>").repartition(3)
    for block in (1 << 20, 100):
        got = {(r.query_id, r.vec_id): r.d2 for r in ann.within(df, df.filter("vec_id < 20"), 1.5, block_bytes=block).collect()}
        want = {(i, j): ((x[i] - x[j]) ** 2).sum() for i in range(20) for j in range(150) if ((x[i] - x[j]) ** 2).sum() < 2.25}
        assert got == pytest.approx(want) and len(want) > 40
    assert ann.within(df, df.limit(0), 1.5).count() == 0


def test_tolerant_dedupe_keeps_points_without_a_place(spark):
    rows = [(1, 1.0, 1.0, 1.0), (2, 1.0, 1.0, 1.000001), (3, 1.0, 1.0, 2.0), (4, None, 1.0, 1.0), (5, None, 1.0, 1.0), (6, math.nan, 0.0, 0.0), (7, 64.0, math.inf, 0.0), (8, 1e6, 0.0, 0.0), (9, 1e6, 0.0, 0.0)]
    df = spark.createDataFrame(rows, POINTS)
    assert sorted(r.point_id for r in filters.adjacent_dedupe(df).collect()) == [1, 3, 4, 5, 6, 7, 8]
