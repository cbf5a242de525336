import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from geomill.operators import dual, mesh, rays, stencil, surface, voxel
from geomill.sources import volumes

FACES = "face_id long, v0 long, v1 long, v2 long"
VOXELS = "x int, y int, z int, gray int"


def _octahedron(first, shift=0):
    tri = [(0, 2, 4), (2, 1, 4), (1, 3, 4), (3, 0, 4), (2, 0, 5), (1, 2, 5), (3, 1, 5), (0, 3, 5)]
    return [(first + i, *(v + shift for v in t)) for i, t in enumerate(tri)]


def _runs(rows):
    return [(r[a], r[b]) for r in rows for a, b in ((1, 2), (2, 3), (3, 1))]


def test_flipped_faces_come_back(spark):
    rng = random.Random(1)
    rows = _octahedron(10) + _octahedron(30, 100)
    bad = {f[0] for f in rows if rng.random() < 0.5}
    df = spark.createDataFrame([(f, c, b, a) if f in bad else (f, a, b, c) for f, a, b, c in rows], FACES)
    got = mesh.oriented(df).collect()
    halves = _runs([tuple(r) for r in got])
    assert len(got) == 16 and len(set(halves)) == 48 and all((b, a) in halves for a, b in halves)
    assert {r.component for r in got} == {10, 30} and all(r.orientable for r in got)
    # The face of least id of each component stays as it was.
    assert all(r.flipped == ((r.face_id in bad) != (r.component in bad)) for r in got)


def test_twisted_strip_and_odd_edges(spark):
    # Seven faces around a Moebius strip of seven vertices.
    strip = [(i, i, (i + 1) % 7, (i + 2) % 7) for i in range(7)]
    fan = [(20, 50, 51, 52), (21, 51, 50, 53), (22, 50, 51, 54), (23, 60, 60, 61)]
    got = {r.face_id: r for r in mesh.oriented(spark.createDataFrame(strip + fan, FACES)).collect()}
    assert all(not got[i].orientable and not got[i].flipped and got[i].component == 0 and (got[i].v0, got[i].v1, got[i].v2) == strip[i][1:] for i in range(7))
    assert all(got[i].orientable and got[i].component == i and not got[i].flipped for i in (20, 21, 22, 23))
    assert mesh.oriented(spark.createDataFrame([], FACES)).count() == 0


def test_faces_follow_normals(spark):
    rows = [(0, 1, 2, 3, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0, 1.0, 0.0, n) for n in (1.0, -1.0, 0.0)]
    names = ["face_id", "v0", "v1", "v2", *(f"{c}{i}" for i in range(3) for c in "xyz"), "nz"]
    df = spark.createDataFrame(rows, names).withColumns({"nx": F.lit(0.3), "ny": F.lit(-2.0)})
    assert sorted((r.v0, r.v1, r.v2) for r in mesh.along_normals(df).collect()) == [(1, 2, 3), (1, 2, 3), (3, 2, 1)]


def test_quadratic_places_are_nearer_a_sphere(spark):
    v = volumes.implicit(spark, 17, "round(1000 - 12 * ((x - c) * (x - c) + (y - c) * (y - c) + (z - c) * (z - c)))")
    radius = math.sqrt((1000 - 500) / 12)
    worst = {}
    for quadratic in (False, True):
        p = surface.crossings(v, 500, quadratic).collect()
        worst[quadratic] = max(abs(math.dist((r.px, r.py, r.pz), (8, 8, 8)) - radius) for r in p)
    assert worst[True] < 1e-6 < 0.01 < worst[False]


def _band(gray, iso, spread, band):
    d, h, w = gray.shape
    label, reached, last = {}, set(), []
    for z, y, x in np.argwhere(gray == iso).tolist():
        label[x, y, z] = "PF"
        last.append((x, y, z))
    reached |= set(last)
    for _ in range(band):
        new = []
        for x, y, z in last:
            if not (1 <= x <= w - 2 and 1 <= y <= h - 2 and 1 <= z <= d - 2):
                continue
            for p in [(x + i, y + j, z + k) for i in (-1, 0, 1) for j in (-1, 0, 1) for k in (-1, 0, 1)]:
                if p not in reached:
                    reached.add(p)
                    new.append(p)
                    g = int(gray[p[2], p[1], p[0]])
                    label[p] = "DB" if g < iso - spread else "DF" if g > iso + spread else "PB" if iso - spread < g < iso else "PF" if iso <= g < iso + spread else None
        last = new
    return label


@pytest.mark.parametrize("band", [0, 1, 3])
def test_band_labels_are_brute_force(spark, band):
    gray = np.random.default_rng(3).integers(0, 40, (7, 6, 8))
    rows = [(x, y, z, int(gray[z, y, x])) for z in range(7) for y in range(6) for x in range(8)]
    got = {(r.x, r.y, r.z): r.label for r in stencil.band_labels(spark.createDataFrame(rows, VOXELS), (8, 6, 7), 20, 5, band).collect()}
    want = _band(gray, 20, 5, band)
    assert got == {(x, y, z): want.get((x, y, z)) for x, y, z, _ in rows}
    assert band == 0 or any((x, y, z) in want and g in (15, 25) and got[x, y, z] is None for x, y, z, g in rows)


def test_profile_edges_lie_on_steps(spark):
    at = np.arange(40)
    # Smooth steps with known places: up at 10.25, down at 27.6.
    value = 1000 / (1 + np.exp(-(at - 10.25) * 1.2)) - 600 / (1 + np.exp(-(at - 27.6) * 1.2))
    rows = [("s", int(i), int(round(v * 100))) for i, v in zip(at, value)] + [("flat", int(i), 500) for i in at] + [("short", int(i), int(i)) for i in range(5)]
    got = sorted(stencil.profile_edges(spark.createDataFrame(rows, "k string, i int, v int"), ["k"], "i", "v", least=2000).collect(), key=lambda r: r.place)
    assert [(r.k, r.rising) for r in got] == [("s", True), ("s", False)]
    assert abs(got[0].place - 10.25) < 0.03 and abs(got[1].place - 27.6) < 0.03 and got[0].strength > got[1].strength
    hard = spark.createDataFrame([("h", i, 0 if i < 20 else 900) for i in range(40)], "k string, i int, v int")
    assert [r.place for r in stencil.profile_edges(hard, ["k"], "i", "v").collect()] == [19.5]


@pytest.mark.parametrize("op", ["erode", "dilate", "open", "close"])
def test_morphology_is_brute_force(spark, op):
    rng = np.random.default_rng(6)
    p = rng.uniform(-10, 10, (150, 3))
    rows = [(i, *map(float, v)) for i, v in enumerate(p)] + [(900, math.nan, 1.0, 1.0), (901, 1.0, 1.0, None)]
    got = {(r.cx, r.cy): r.z for r in voxel.height_morphology(spark.createDataFrame(rows, "point_id long, x double, y double, z double"), 1.5, 2, op).collect()}
    steps = {"erode": (min,), "dilate": (max,), "open": (min, max), "close": (max, min)}[op]
    cells = {}
    for x, y, z in p.tolist():
        c = (math.floor(x / 1.5), math.floor(y / 1.5))
        cells[c] = steps[0](cells.get(c, z), z)
    # Cells without points break a square: rows first, then columns of what the rows gave.
    for f in steps:
        for a in (0, 1):
            cells = {c: f(v for o, v in cells.items() if abs(o[a] - c[a]) <= 2 and o[1 - a] == c[1 - a]) for c in cells}
    assert got == cells


def _label_volume(spark, label, n):
    rows = [(x, y, z, int(label[z, y, x])) for z in range(n) for y in range(n) for x in range(n)]
    return spark.createDataFrame(rows, "x int, y int, z int, label int")


def _halves(quads):
    """Directed edges of each label's quads, by named vertices."""
    out = {}
    for r in quads:
        ring = [(c.cx, c.cy, c.cz, c.patch) for c in r.corners]
        out.setdefault(r.label, []).extend(zip(ring, ring[1:] + ring[:1]))
    return out


def test_labelled_surfaces_are_closed(spark):
    rng = np.random.default_rng(11)
    label = rng.integers(0, 4, (6, 6, 6))
    quads = dual.label_surfaces(_label_volume(spark, label, 6)).collect()
    for own in _halves(quads).values():
        count = {}
        for a, b in own:
            count[a, b] = count.get((a, b), 0) + 1
        assert all(count[a, b] == count.get((b, a), 0) for a, b in count)
    padded = np.pad(label, 1)
    faces = {}
    for axis in range(3):
        lo, hi = np.moveaxis(padded, axis, 0)[:-1], np.moveaxis(padded, axis, 0)[1:]
        for a, b in zip(lo.ravel().tolist(), hi.ravel().tolist()):
            if a != b:
                for own, other in ((a, b), (b, a)):
                    if own:
                        faces[own, other] = faces.get((own, other), 0) + 1
    got = {}
    for r in quads:
        got[r.label, r.other] = got.get((r.label, r.other), 0) + 1
    assert got == faces


def test_nested_balls_enclose_their_voxels(spark):
    n = 19
    z, y, x = np.indices((n, n, n)) - n // 2
    d2 = x * x + y * y + z * z
    label = np.where(d2 <= 16, 2, np.where(d2 <= 49, 1, 0))
    quads = dual.label_surfaces(_label_volume(spark, label, n))
    volume = {r.label: r.volume for r in dual.enclosed(quads).collect()}
    assert volume[2] == pytest.approx((label == 2).sum(), rel=0.08) and volume[1] == pytest.approx((label == 1).sum(), rel=0.08)
    pair = [r for r in quads.collect() if {r.label, r.other} == {1, 2}]
    # The surface between both balls alone is closed too, seen from either side.
    for own in _halves(pair).values():
        assert len(set(own)) == len(own) and all((b, a) in set(own) for a, b in own)
    box = np.zeros((14, 14, 14), int)
    box[1:13, 1:12, 2:12] = 3
    assert dual.enclosed(dual.label_surfaces(_label_volume(spark, box, 14))).first().volume == pytest.approx(12 * 11 * 10, rel=0.06)


def test_patches_of_a_cell():
    assert dual.patches(1) == [[0, 4, 8]] and dual.patches(0b11) == [[4, 5, 8, 9]]
    assert sorted(map(len, dual.patches(0b10000001))) == [3, 3]  # opposite corners
    assert sorted(map(len, dual.patches(0b1001))) == [3, 3]  # corners across a face stay apart
    assert all(sum(map(len, dual.patches(c))) == sum((c >> dual.CORNERS.index(e[1]) & 1) != (c >> dual.CORNERS.index(dual._upper(e)) & 1) for e in dual.EDGES) for c in range(256))


def test_box_polygons_are_in_order(spark):
    boxes = spark.createDataFrame([(1, 0.0, 2.0, 0.0, 2.0, 0.0, 2.0), (2, 0.0, 2.0, 0.0, 2.0, -9.0, -8.0)], "tile int, x0 double, x1 double, y0 double, y1 double, z0 double, z1 double")
    got = rays.box_plane_polygons(boxes, "tile", (1, 1, 1), -3.0).withColumn("area2", rays.polygon_area2("polygon")).collect()
    ring = [tuple(p) for p in got[0].polygon]
    # A regular hexagon through the middles of six edges: neighbours are as near as can be.
    assert [r.tile for r in got] == [1] and len(ring) == 6
    assert all(math.dist(a, b) == pytest.approx(math.sqrt(2)) for a, b in zip(ring, ring[1:] + ring[:1]))
    assert got[0].area2 == pytest.approx(6 * math.sqrt(3))
    turn = np.cross(np.subtract(ring[1], ring[0]), np.subtract(ring[2], ring[1]))
    assert turn @ [1, 1, 1] > 0


def test_labels_along_gradient_are_brute_force(spark):
    rng = np.random.default_rng(15)
    z, y, x = np.indices((16, 16, 16))
    gray = np.clip(900 - 9 * ((x - 8) ** 2 + (y - 7) ** 2 + (z - 8) ** 2) + rng.integers(-40, 40, (16, 16, 16)), 0, None).astype(int)
    materials, core = [(0, 150, 1), (150, 600, 2), (600, 1000, 3)], 60
    label = lambda v: next((n for a, b, n in materials if a <= v < b), None)
    sure = lambda v: any(a + core <= v < b - core for a, b, _ in materials)
    slope, smooth = (1, 0, -1), (1, 2, 1)
    weights = [np.einsum("i,j,k->kji", *(slope if c == a else smooth for c in range(3))) for a in range(3)]
    step = {}
    for k, j, i in np.ndindex(gray.shape):
        v = gray[k, j, i]
        if sure(v) or not all(1 <= c <= 14 for c in (i, j, k)):
            continue
        g = [int((w * gray[k - 1 : k + 2, j - 1 : j + 2, i - 1 : i + 2]).sum()) for w in weights]
        most = max(map(abs, g))
        t = tuple(p - (np.sign(c) if most and 2 * abs(c) >= most else 0) for p, c in zip((i, j, k), g))
        if gray[t[2], t[1], t[0]] > v:
            step[i, j, k] = t
    want, longest = {}, 0
    for k, j, i in np.ndindex(gray.shape):
        p, n = (i, j, k), 0
        while p in step:
            p, n = step[p], n + 1
        longest = max(longest, n)
        want[i, j, k] = label(gray[p[2], p[1], p[0]])
    rows = [(i, j, k, int(gray[k, j, i])) for k, j, i in np.ndindex(gray.shape)]
    got = {(r.x, r.y, r.z): r.label for r in stencil.labels_along_gradient(spark.createDataFrame(rows, VOXELS), materials, core).collect()}
    assert got == want and longest >= 2
    assert any(want[i, j, k] != label(v) for i, j, k, v in rows)


def test_rays_cross_a_sphere(spark):
    v = volumes.implicit(spark, 25, "round(20000 - 100 * ((x - c) * (x - c) + (y - c) * (y - c) + (z - c) * (z - c)))")
    rng = np.random.default_rng(16)
    d = rng.normal(size=(20, 3))
    d /= np.linalg.norm(d, axis=1)[:, None]
    rows = [(i, 12.0, 12.0, 12.0, *map(float, u), 14.0) for i, u in enumerate(d)] + [(50, 12.0, 12.0, 12.0, 1.0, 0.0, 0.0, 5.0)]
    r = spark.createDataFrame(rows, "ray_id long, ox double, oy double, oz double, dx double, dy double, dz double, length double")
    got = {r.ray_id: r for r in rays.iso_crossings_along(r, v, (25, 25, 25), 13600).collect()}
    # gray 13600 lies 8 voxels from the middle; the ray of length 5 doesn't get there.
    assert set(got) == set(range(20)) and all(abs(got[i].t - 8) < 0.1 for i in range(20))
    assert all((got[i].px, got[i].py, got[i].pz) == pytest.approx(tuple(12 + got[i].t * d[i])) for i in range(20))
