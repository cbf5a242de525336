"""k nearest neighbours on the k-d partition against all pairs."""

import numpy as np
import pytest

from geomill.operators import kd, neighbors

POINTS = "point_id long, x double, y double, z double"


def _cloud(seed: int, n: int = 1500) -> np.ndarray:
    """Clusters of very different density, far points, equal points and a lattice with many ties."""
    rng = np.random.default_rng(seed)
    parts = [rng.normal(c, s, (n // 4, 3)) for c, s in ((0, 1e-3), (5, 1), (-40, 20))]
    lattice = np.stack(np.meshgrid(*[np.arange(6.0)] * 3), -1).reshape(-1, 3) + 100
    return np.concatenate([*parts, lattice, np.full((n // 4, 3), 3.25), [[1e6, 1e6, 1e6], [-1e7, 0, 0], [1e6, 1e6, 1e6]]])


def _brute(p, q, k, within=None):
    out = set()
    for i, x in enumerate(q):
        d = p - x
        d2 = d[:, 0] * d[:, 0] + d[:, 1] * d[:, 1] + d[:, 2] * d[:, 2]
        near = np.lexsort((np.arange(len(p)), d2))[:k]
        out |= {(i, int(j), float(d2[j]), r + 1) for r, j in enumerate(near) if within is None or d2[j] < within}
    return out


def _frames(spark, p, q):
    make = lambda x, name: spark.createDataFrame([(i, *map(float, v)) for i, v in enumerate(x)], POINTS.replace("point_id", name)).repartition(5)
    return make(p, "point_id"), make(q, "query_id")


@pytest.mark.parametrize("k", [1, 7, 40])
def test_many_leaves_are_brute_force(spark, monkeypatch, k):
    monkeypatch.setattr(kd, "LEAF", 60)
    monkeypatch.setattr(kd, "CHUNK", 50)
    p = _cloud(k)
    q = np.concatenate([p[::9], np.random.default_rng(1).uniform(-200, 200, (40, 3)), [[1e9, -1e9, 5.0], [0.0, 0.0, 0.0]], np.full((120, 3), 3.25)])
    got = {tuple(r) for r in neighbors.knn(*_frames(spark, p, q), k).collect()}
    assert got == _brute(p, q, k)


def test_capped_radius_is_brute_force(spark, monkeypatch):
    monkeypatch.setattr(kd, "LEAF", 60)
    p = _cloud(2)
    q = np.concatenate([p[::9], [[3.25, 3.25, 13.25], [1e8, 0, 0]]])
    for radius in (1.0, 10.0):
        got = {tuple(r) for r in neighbors.capped_radius_join(*_frames(spark, p, q), radius, 5).collect()}
        assert got == _brute(p, q, 5, radius * radius)


def test_more_asked_than_there_are(spark):
    p = _cloud(3, 40)[:20]
    assert {tuple(r) for r in neighbors.knn(*_frames(spark, p, p), 50).collect()} == _brute(p, p, 50)
    assert neighbors.knn(*_frames(spark, p, p[:0]), 3).count() == 0


def test_a_far_point_costs_little():
    p = np.random.default_rng(0).random((3000, 3))
    far = np.concatenate([p, [[1e6] * 3]])
    pairs = [kd.search(x, x, 6, np.full(len(x), np.inf))[2] for x in (p, far)]
    assert pairs[1] < 1.1 * pairs[0] and pairs[0] < 1000 * len(p)


def test_dense_clusters_cost_no_more_than_even_points():
    rng = np.random.default_rng(4)
    even = rng.random((4000, 3))
    dense = np.concatenate([rng.normal(c, s, (1000, 3)) for c, s in ((0, 1e-4), (1, 1e-2), (9, 1), (1000, 50))])
    pairs = [kd.search(x, x, 6, np.full(len(x), np.inf))[2] for x in (even, dense)]
    assert pairs[1] < 2 * pairs[0]


def test_leaves_follow_the_density():
    p = np.concatenate([np.random.default_rng(5).normal(0, 1e-6, (9000, 3)), np.random.default_rng(6).uniform(-1e3, 1e3, (1000, 3))])
    tree = kd.split(p[::5], 5)
    n = np.bincount(tree.leaf(p), minlength=32)
    assert n.max() < 2 * len(p) / 32


def test_points_of_a_hot_place_are_few(spark):
    p = _cloud(8)
    df, _ = _frames(spark, p, p[:1])
    few = kd._thinned(df, np.array([[3.25] * 3]), 4, "point_id").collect()
    at = [i for i, x in enumerate(p) if (x == 3.25).all()]
    assert sorted(r.point_id for r in few) == sorted(set(range(len(p))) - set(at[4:]))


def test_empty_leaves_begin_next_door():
    assert kd._homes(np.array([5, 0, 1, 9]), 3).tolist() == [0, 0, 3, 3]
    assert kd._homes(np.array([1, 0, 0, 1]), 3).tolist() == [0, 0, 0, 0]
