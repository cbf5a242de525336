"""Mesh files in binary forms: PLY (text too), indexed face sets, and containers of a volume with its mesh.

A file is read as one row and parsed in a task by array expressions; many files are read in
parallel. Vertices are (path, id, x, y, z), triangles (path, face_id, v0, v1, v2); polygons become fans.
"""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: Fixed by the PLY format: names of types to numpy's, without the byte order.
PLY_TYPES = {"char": "i1", "int8": "i1", "uchar": "u1", "uint8": "u1", "short": "i2", "int16": "i2", "ushort": "u2", "uint16": "u2", "int": "i4", "int32": "i4", "uint": "u4", "uint32": "u4", "float": "f4", "float32": "f4", "double": "f8", "float64": "f8"}
#: Fixed by the container format: width, height, depth, bytes and components of a voxel; origin and step; gray of air; then the voxels, the counts and the arrays.
VOLUME_HEAD, COUNTS = ">5i6dI", ">2q"
HEAD_BYTES = struct.calcsize(VOLUME_HEAD)

Parsed = tuple[np.ndarray, np.ndarray]


def fans(sizes: np.ndarray, flat: np.ndarray) -> np.ndarray:
    """Triangles of polygons given end to end: the first corner with each pair of later neighbours."""
    n = np.maximum(sizes - 2, 0)
    first = np.repeat(np.cumsum(sizes) - sizes, n)
    k = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    return np.stack([flat[first], flat[first + k + 1], flat[first + k + 2]], axis=1).astype(np.int64).reshape(-1, 3)


def _ply_head(data: bytes) -> tuple[str, list[tuple[str, int, list[list[str]]]], int]:
    """Format, elements as (name, count, properties), and where the values begin."""
    if not data.startswith(b"ply"):
        raise ValueError("not a PLY file")
    end = data.index(b"\n", data.index(b"end_header")) + 1
    kind, elements = "", []
    for line in data[:end].decode("ascii").splitlines():
        w = line.split()
        if w[:1] == ["format"]:
            kind = w[1]
        elif w[:1] == ["element"]:
            elements.append((w[1], int(w[2]), []))
        elif w[:1] == ["property"]:
            elements[-1][2].append(w[1:])
    return kind, elements, end


def _text_element(tokens: list[bytes], at: int, count: int, properties: list[list[str]]) -> tuple[dict, int]:
    if all(p[0] != "list" for p in properties):
        k = len(properties)
        table = np.array(tokens[at : at + count * k], "S32").astype(float).reshape(count, k)
        return {p[-1]: table[:, i] for i, p in enumerate(properties)}, at + count * k
    out: dict[str, list] = {p[-1]: [] for p in properties}
    for _ in range(count):
        for p in properties:
            n = int(tokens[at]) if p[0] == "list" else 1
            at += p[0] == "list"
            out[p[-1]].append([float(t) for t in tokens[at : at + n]])
            at += n
    return {k: (np.array([len(v) for v in vs]), np.array([x for v in vs for x in v])) for k, vs in out.items()}, at


def _binary_element(data: bytes, at: int, count: int, properties: list[list[str]], order: str) -> tuple[dict, int]:
    kind = lambda name: np.dtype(order + PLY_TYPES[name])
    if all(p[0] != "list" for p in properties):
        record = np.dtype([(p[1], kind(p[0])) for p in properties])
        table = np.frombuffer(data, record, count, at)
        return {p[1]: table[p[1]] for p in properties}, at + count * record.itemsize
    # Most files have lists of one length in every row: then a row is a record.
    lengths, here = [], at
    for p in properties:
        n = int(np.frombuffer(data, kind(p[1]), 1, here)[0]) if p[0] == "list" and count else 1
        lengths.append(n)
        here += kind(p[1]).itemsize + n * kind(p[2]).itemsize if p[0] == "list" else kind(p[0]).itemsize
    fields = []
    for i, (p, n) in enumerate(zip(properties, lengths)):
        fields += [(f"n{i}", kind(p[1])), (f"v{i}", kind(p[2]), (n,))] if p[0] == "list" else [(f"v{i}", kind(p[0]), (1,))]
    record = np.dtype(fields)
    if count and len(data) >= at + count * record.itemsize:
        table = np.frombuffer(data, record, count, at)
        if all((table[f"n{i}"] == n).all() for i, (p, n) in enumerate(zip(properties, lengths)) if p[0] == "list"):
            return {p[-1]: (np.full(count, n), table[f"v{i}"].ravel()) for i, (p, n) in enumerate(zip(properties, lengths))}, at + count * record.itemsize
    out: dict[str, list] = {p[-1]: [] for p in properties}
    for _ in range(count):
        for p in properties:
            n = 1
            if p[0] == "list":
                n = int(np.frombuffer(data, kind(p[1]), 1, at)[0])
                at += kind(p[1]).itemsize
            own = kind(p[-2])
            out[p[-1]].append(np.frombuffer(data, own, n, at))
            at += n * own.itemsize
    return {k: (np.array([len(v) for v in vs]), np.concatenate(vs) if vs else np.zeros(0)) for k, vs in out.items()}, at


def parse_ply(data: bytes) -> Parsed:
    """Vertices and triangles of a PLY file, text or binary of either byte order, whatever other elements and properties it has."""
    kind, elements, at = _ply_head(data)
    tokens = data[at:].split() if kind == "ascii" else []
    place, held = 0 if kind == "ascii" else at, {}
    for name, count, properties in elements:
        if kind == "ascii":
            held[name], place = _text_element(tokens, place, count, properties)
        else:
            held[name], place = _binary_element(data, place, count, properties, "<" if kind == "binary_little_endian" else ">")
    v = held["vertex"]
    xyz = np.stack([np.asarray(v[c][1] if isinstance(v[c], tuple) else v[c], float) for c in "xyz"], axis=1)
    corners = next((held["face"][c] for c in ("vertex_indices", "vertex_index") if c in held.get("face", {})), (np.zeros(0, int), np.zeros(0)))
    return xyz, fans(*corners)


def parse_ifs(data: bytes) -> Parsed:
    """Vertices and triangles of an indexed face set (versions 1.0 and 1.1)."""

    def word(at: int) -> tuple[str, int]:
        (n,) = struct.unpack_from("<I", data, at)
        return data[at + 4 : at + 4 + n].split(b"\0")[0].decode("ascii"), at + 4 + n

    magic, at = word(0)
    (version,) = struct.unpack_from("<f", data, at)
    if magic != "IFS" or round(version, 3) not in (1.0, 1.1):
        raise ValueError("not an indexed face set of version 1.0 or 1.1")
    _, at = word(at + 4)
    xyz, tri = np.zeros((0, 3)), np.zeros((0, 3), np.int64)
    while at < len(data):
        key, at = word(at)
        (n,) = struct.unpack_from("<I", data, at)
        kind = {"VERTICES": "<f4", "TRIANGLES": "<u4"}.get(key)
        if kind is None:  # texture coordinates and what else may follow
            break
        table = np.frombuffer(data, kind, 3 * n, at + 4).reshape(n, 3)
        xyz, tri = (table.astype(float), tri) if key == "VERTICES" else (xyz, table.astype(np.int64))
        at += 4 + table.nbytes
    return xyz, tri


def volume_head(data: bytes) -> dict:
    """Header of a container and where its parts begin."""
    w, h, d, size, components, *place, air = struct.unpack_from(VOLUME_HEAD, data)
    mesh = HEAD_BYTES + w * h * d * size * components
    vertices, faces = struct.unpack_from(COUNTS, data, mesh)
    return {"dims": (w, h, d), "size": size, "components": components, "origin": tuple(place[:3]), "step": tuple(place[3:]), "air": air, "vertices": vertices, "faces": faces, "mesh": mesh + struct.calcsize(COUNTS)}


def parse_container(data: bytes) -> Parsed:
    head = volume_head(data)
    n, at = head["vertices"], head["mesh"]
    xyz = np.frombuffer(data, "<f4", 3 * n, at).reshape(n, 3).astype(float)
    return xyz, np.frombuffer(data, "<u4", 3 * head["faces"], at + 24 * n).reshape(-1, 3).astype(np.int64)


def container_bytes(gray: np.ndarray, xyz: np.ndarray, normals: np.ndarray, faces: np.ndarray, origin: tuple = (0.0, 0.0, 0.0), step: tuple = (1.0, 1.0, 1.0), air: int = 0) -> bytes:
    """A container of a volume (depth, height, width) of one or two bytes a voxel and its mesh."""
    d, h, w = gray.shape
    raw = gray.astype("<u2" if gray.dtype.itemsize > 1 else "u1")
    head = struct.pack(VOLUME_HEAD, w, h, d, raw.dtype.itemsize, 1, *origin, *step, air)
    return head + raw.tobytes() + struct.pack(COUNTS, len(xyz), len(faces)) + xyz.astype("<f4").tobytes() + normals.astype("<f4").tobytes() + faces.astype("<u4").tobytes()


def _mesh(spark: SparkSession, path: str, parse: Callable[[bytes], Parsed]) -> tuple[DataFrame, DataFrame]:
    files = spark.read.format("binaryFile").load(path).select("path", "content")

    def part(which: int, names: list[str], kind: pa.DataType) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for name, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                    table = parse(bytes(content.as_buffer()))[which]
                    yield pa.RecordBatch.from_arrays([pa.array([name] * len(table), pa.string()), pa.array(np.arange(len(table))), *(pa.array(table[:, i], kind) for i in range(3))], names=names)

        return run

    vertices = files.mapInArrow(part(0, ["path", "id", "x", "y", "z"], pa.float64()), "path string, id long, x double, y double, z double")
    return vertices, files.mapInArrow(part(1, ["path", "face_id", "v0", "v1", "v2"], pa.int64()), "path string, face_id long, v0 long, v1 long, v2 long")


def read_ply(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Vertices and triangles of PLY files, text and binary mixed as they come."""
    return _mesh(spark, path, parse_ply)


def read_ifs(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    return _mesh(spark, path, parse_ifs)


def read_container(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Voxels (path, x, y, z, gray of the first component), vertices and triangles of containers."""

    def voxels(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                data = memoryview(content.as_buffer())
                head = volume_head(data)
                w, h, d = head["dims"]
                n = w * h * head["components"]
                gray = np.frombuffer(data, "<u2" if head["size"] == 2 else "u1", n * d, HEAD_BYTES)[:: head["components"]]
                i = np.arange(w * h, dtype=np.int32)
                for z in range(d):
                    part = gray[z * w * h : (z + 1) * w * h].astype(np.int32)
                    yield pa.RecordBatch.from_arrays([pa.array([name] * len(part), pa.string()), *(pa.array(v) for v in (i % w, i // w, np.full(len(part), z, np.int32), part))], names=["path", "x", "y", "z", "gray"])

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return (files.mapInArrow(voxels, "path string, x int, y int, z int, gray int"), *_mesh(spark, path, parse_container))
