import struct

import numpy as np
import pytest

from geomill.sources import clouds, meshes

XYZ = np.array([[0, 0, 0], [1, 0, 0.5], [1, 1, 0], [0, 1, 0], [2, 2, 2]], float)
POLYGONS = [[0, 1, 2, 3], [0, 2, 4]]
WANT = [(0, 0, 1, 2), (1, 0, 2, 3), (2, 0, 2, 4)]


def _ply(kind, order="<", even=False):
    polygons = [[0, 1, 2], [2, 3, 4]] if even else POLYGONS
    head = f"ply\nformat {kind} 1.0\ncomment element vertex 9\nelement vertex 5\nproperty uchar red\nproperty float x\nproperty double y\nproperty float z\nelement face {len(polygons)}\nproperty uchar flag\nproperty list uchar int vertex_indices\nelement edge 1\nproperty int a\nend_header\n".encode()
    if kind == "ascii":
        body = "".join(f"7 {x} {y} {z}\n" for x, y, z in XYZ.tolist()) + "".join(f"1 {len(p)} {' '.join(map(str, p))}\n" for p in polygons) + "3\n"
        return head + body.encode()
    body = b"".join(struct.pack(order + "Bfdf", 7, *v) for v in XYZ.tolist()) + b"".join(struct.pack(f"{order}BB{len(p)}i", 1, len(p), *p) for p in polygons)
    return head + body + struct.pack(order + "i", 3)


def _rows(pair):
    v, f = pair
    return [tuple(r)[1:] for r in v.orderBy("path", "id").collect()], [tuple(r)[1:] for r in f.orderBy("path", "face_id").collect()]


@pytest.mark.parametrize("even", [False, True])
def test_ply_in_every_form(spark, tmp_path, even):
    for name, data in (("a", _ply("ascii", even=even)), ("b", _ply("binary_little_endian", "<", even)), ("c", _ply("binary_big_endian", ">", even))):
        (tmp_path / f"{name}.ply").write_bytes(data)
    v, f = _rows(meshes.read_ply(spark, str(tmp_path / "*.ply")))
    want = [(0, 0, 1, 2), (1, 2, 3, 4)] if even else WANT
    assert v == [(i, *p) for i, p in enumerate(XYZ.tolist())] * 3 and f == want * 3


def test_text_ply_is_read_alike(spark, tmp_path):
    text = "ply\nformat ascii 1.0\nelement vertex 5\nproperty float x\nproperty float y\nproperty float z\nelement face 2\nproperty list uchar int vertex_index\nend_header\n" + "".join(f"{x} {y} {z}\n" for x, y, z in XYZ.tolist()) + "4 0 1 2 3\n3 0 2 4\n"
    (tmp_path / "t.ply").write_text(text)
    assert _rows(meshes.read_ply(spark, str(tmp_path / "t.ply"))) == _rows(clouds.read_ply(spark, str(tmp_path / "t.ply")))


def test_ply_without_faces(spark, tmp_path):
    (tmp_path / "p.ply").write_bytes(b"ply\nformat binary_little_endian 1.0\nelement vertex 1\nproperty float x\nproperty float y\nproperty float z\nend_header\n" + struct.pack("<3f", 1, 2, 3))
    assert _rows(meshes.read_ply(spark, str(tmp_path / "p.ply"))) == ([(0, 1.0, 2.0, 3.0)], [])
    with pytest.raises(ValueError, match="not a PLY"):
        meshes.parse_ply(b"solid")


def test_indexed_face_set(spark, tmp_path):
    word = lambda s: struct.pack("<I", len(s) + 1) + s.encode() + b"\0"
    tri = np.array([[0, 1, 2], [0, 2, 3]], "<u4")
    data = word("IFS") + struct.pack("<f", 1.1) + word("shape") + word("VERTICES") + struct.pack("<I", 5) + XYZ.astype("<f4").tobytes() + word("TRIANGLES") + struct.pack("<I", 2) + tri.tobytes() + word("TEXTURECOORD") + struct.pack("<I", 0)
    (tmp_path / "s.ifs").write_bytes(data)
    v, f = _rows(meshes.read_ifs(spark, str(tmp_path / "s.ifs")))
    assert v == [(i, *p) for i, p in enumerate(XYZ.tolist())] and f == [(0, 0, 1, 2), (1, 0, 2, 3)]
    with pytest.raises(ValueError, match="indexed face set"):
        meshes.parse_ifs(word("IFS") + struct.pack("<f", 2.0) + word("x"))


@pytest.mark.parametrize("kind", [np.uint8, np.uint16])
def test_container_round_trip(spark, tmp_path, kind):
    gray = (np.arange(3 * 4 * 5) * (1000 if kind == np.uint16 else 1)).astype(kind).reshape(3, 4, 5)
    tri = np.array([[0, 1, 2], [0, 2, 4]])
    (tmp_path / "c.bin").write_bytes(meshes.container_bytes(gray, XYZ, np.ones_like(XYZ), tri, step=(0.5, 0.5, 0.25), air=9))
    voxels, v, f = meshes.read_container(spark, str(tmp_path / "c.bin"))
    assert {(r.x, r.y, r.z): r.gray for r in voxels.collect()} == {(x, y, z): int(gray[z, y, x]) for z in range(3) for y in range(4) for x in range(5)}
    assert _rows((v, f)) == ([(i, *p) for i, p in enumerate(XYZ.tolist())], [(0, 0, 1, 2), (1, 0, 2, 4)])
    head = meshes.volume_head((tmp_path / "c.bin").read_bytes())
    assert head["dims"] == (5, 4, 3) and head["step"] == (0.5, 0.5, 0.25) and head["air"] == 9
