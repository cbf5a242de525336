import math
import struct

import numpy as np

from geomill.sources import clouds, volumes


def test_raw_volume_round_trip(spark, tmp_path):
    gray = np.arange(5 * 4 * 19) % 60000
    (tmp_path / "a.raw").write_bytes(volumes.raw_bytes(gray))
    df = volumes.read_raw(spark, str(tmp_path / "a.raw"), (5, 4, 19))
    rows = {(r.x, r.y, r.z): r.gray for r in df.collect()}
    assert len(rows) == 380 and all(rows[i % 5, i // 5 % 4, i // 20] == g for i, g in enumerate(gray))
    slabs = volumes.encode_raw(df, (5, 4, 19)).orderBy("z0").collect()
    assert b"".join(r.data for r in slabs) == gray.astype("<u2").tobytes()


def test_vgi(spark, tmp_path):
    (tmp_path / "v.vgi").write_text("{volume}\nsize = 3 2 2\nresolution = 0.25 0.25 0.25\n")
    (tmp_path / "v.raw").write_bytes(np.arange(12, dtype="<u2").tobytes())
    df, step = volumes.read_vgi(spark, str(tmp_path / "v.vgi"), str(tmp_path / "v.raw"))
    assert step == 0.25 and sorted(r.gray for r in df.collect()) == list(range(12))


def test_tiles_prune(spark, tmp_path):
    v = volumes.implicit(spark, 16)
    volumes.write_tiles(v, str(tmp_path / "t"), 8)
    part = volumes.read_tiles(spark, str(tmp_path / "t"), (2, 3, 9), (6, 9, 12), 8)
    want = {(r.x, r.y, r.z, r.gray) for r in v.collect() if 2 <= r.x < 6 and 3 <= r.y < 9 and 9 <= r.z < 12}
    assert {tuple(r) for r in part.collect()} == want
    assert "PartitionFilters: [isnotnull(tz" in part._jdf.queryExecution().toString()


def _pcd(mode, body, n=3):
    return f"# .PCD v0.7\nVERSION 0.7\nFIELDS x y z _ n\nSIZE 4 4 4 1 2\nTYPE F F F U U\nCOUNT 1 1 1 1 2\nWIDTH {n}\nHEIGHT 1\nPOINTS {n}\nDATA {mode}\n".encode() + body


def test_pcd_modes(spark, tmp_path):
    rows = [(1.5, 2.0, -3.0, 7, (1, 65535)), (0.0, 0.25, 9.0, 8, (2, 3)), (math.inf, 1.0, 1.0, 9, (4, 5))]
    text = "".join(f"{a} {b} {c} {d} {e[0]} {e[1]}\n" for a, b, c, d, e in rows).encode()
    binary = b"".join(struct.pack("<fffBHH", a, b, c, d, *e) for a, b, c, d, e in rows)
    columns = b"".join([*(struct.pack("<3f", *(r[i] for r in rows)) for i in range(3)), bytes(r[3] for r in rows), b"".join(struct.pack("<HH", *r[4]) for r in rows)])
    packed = b"".join(bytes([len(columns[i : i + 32]) - 1]) + columns[i : i + 32] for i in range(0, len(columns), 32))
    compressed = struct.pack("<II", len(packed), len(columns)) + packed
    for mode, body in (("ascii", text), ("binary", binary), ("binary_compressed", compressed)):
        path = tmp_path / f"{mode}.pcd"
        path.write_bytes(_pcd(mode, body))
        df = clouds.read_pcd(spark, str(path))
        assert dict(df.dtypes)["n"] == "array<int>"
        assert [(r.x, r.y, r.z, tuple(r.n)) for r in df.orderBy("point_id").collect()] == [(a, b, c, e) for a, b, c, _, e in rows]


def test_lzf_back_reference():
    assert clouds._lzf(bytes([2]) + b"abc" + bytes([(4 << 5), 2]) + bytes([0]) + b"z", 10) == b"abcabcabcz"


def test_pcd_write(spark, tmp_path):
    df = spark.createDataFrame([(1.0, 2.0, 3.5)], "x double, y double, z double").coalesce(1)
    (tmp_path / "w.pcd").write_text(clouds.write_pcd(df).first()[0])
    r = clouds.read_pcd(spark, str(tmp_path / "w.pcd")).first()
    assert (r.x, r.y, r.z) == (1.0, 2.0, 3.5)


def test_stl_and_index(spark, tmp_path):
    tri = [[(0, 0, 1), (0, 0, 0), (1, 0, 0), (0, 1, 0)], [(0, 0, 1), (1, 0, 0), (1, 1, 0), (0, 1, 0)]]
    body = b"".join(struct.pack("<12fH", *(v for p in t for v in p), 0) for t in tri)
    (tmp_path / "b.stl").write_bytes(bytes(80) + struct.pack("<I", 2) + body)
    text = "solid s\n" + "".join("facet normal {} {} {}\nouter loop\n".format(*t[0]) + "".join("vertex {} {} {}\n".format(*p) for p in t[1:]) + "endloop\nendfacet\n" for t in tri) + "endsolid s\n"
    (tmp_path / "t.stl").write_text(text)
    a, b = (clouds.read_stl(spark, str(tmp_path / n)).drop("path").orderBy("face_id").collect() for n in ("b.stl", "t.stl"))
    assert a == b and len(a) == 2
    vertices, faces = clouds.indexed(clouds.read_stl(spark, str(tmp_path / "b.stl")))
    assert vertices.count() == 4 and faces.count() == 2


def test_obj(spark, tmp_path):
    (tmp_path / "m.obj").write_text("# m\nv 0 0 0\nv 1 0 0\nv 1 1 0\nv 0 1 0\nf 1/1 2/2 3/3 4/4\nf -4 -3 -2\n")
    v, f = clouds.read_obj(spark, str(tmp_path / "m.obj"))
    assert v.count() == 4
    assert sorted((r.v0, r.v1, r.v2) for r in f.collect()) == [(0, 1, 2), (0, 1, 2), (0, 2, 3)]


def test_ply(spark, tmp_path):
    (tmp_path / "m.ply").write_text("ply\nformat ascii 1.0\nelement vertex 4\nproperty float x\nproperty float y\nproperty float z\nelement face 1\nproperty list uchar int vertex_indices\nend_header\n0 0 0\n1 0 0\n1 1 0\n0 1 0\n4 0 1 2 3\n")
    v, f = clouds.read_ply(spark, str(tmp_path / "m.ply"))
    assert [r.x for r in v.orderBy("id").collect()] == [0, 1, 1, 0]
    assert sorted((r.v0, r.v1, r.v2) for r in f.collect()) == [(0, 1, 2), (0, 2, 3)]


def test_xyz_and_contour(spark, tmp_path):
    (tmp_path / "p.xyz").write_text("1 2 3\nbad line here\n4 5\n 6  7 8.5 9\n")
    assert sorted(tuple(r) for r in clouds.read_xyz(spark, str(tmp_path / "p.xyz")).collect()) == [(1, 2, 3), (6, 7, 8.5)]
    (tmp_path / "c").write_text("scbada 1 2 3\nx 1.5 2 3\nkraft 0 0 1\nstatus/t 1 2\nx 4 5 6\nkraft 1 0 0\nstatus/t 1 2\n")
    rows = clouds.read_contour(spark, str(tmp_path / "c")).orderBy("nth").collect()
    assert [(r.x, r.fz, r.fx) for r in rows] == [(1.5, 1.0, 0.0), (4.0, 0.0, 1.0)]
