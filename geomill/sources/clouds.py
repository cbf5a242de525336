"""Readers and writers of point cloud, mesh and measurement files.

Text formats go through Spark's text source and Column functions; binary ones through
binaryFile and Arrow. Each file is one row at first: formats with a header cannot be
split, and many files are read in parallel.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Fixed by the format: letter and size of a field to the numpy type; unsigned types widen in Spark.
PCD_TYPES = {"F4": "<f4", "F8": "<f8", "I1": "i1", "I2": "<i2", "I4": "<i4", "U1": "u1", "U2": "<u2", "U4": "<u4"}
SPARK_TYPES = {"F4": T.FloatType(), "F8": T.DoubleType(), "I1": T.ByteType(), "I2": T.ShortType(), "I4": T.IntegerType(), "U1": T.ShortType(), "U2": T.IntegerType(), "U4": T.LongType()}
ARROW_TYPES = {"F4": pa.float32(), "F8": pa.float64(), "I1": pa.int8(), "I2": pa.int16(), "I4": pa.int32(), "U1": pa.int16(), "U2": pa.int32(), "U4": pa.int64()}


def pcd_header(data: bytes) -> tuple[dict[str, list[str]], int]:
    """Header entries and where the points begin."""
    at, head = 0, {}
    while True:
        end = data.index(b"\n", at)
        line = data[at:end].decode("ascii").strip()
        at = end + 1
        if line and not line.startswith("#"):
            key, *values = line.split()
            head[key.upper()] = values
            if key.upper() == "DATA":
                return head, at


def _lzf(data: bytes, size: int) -> bytes:
    """Decompress the format's byte-pair dictionary coding: literal runs and back references."""
    out, i = bytearray(), 0
    while i < len(data):
        c = data[i]
        i += 1
        if c < 32:
            out += data[i : i + c + 1]
            i += c + 1
            continue
        n = c >> 5
        if n == 7:
            n += data[i]
            i += 1
        ref = len(out) - ((c & 31) << 8) - data[i] - 1
        i += 1
        for _ in range(n + 2):
            out.append(out[ref])
            ref += 1
    if len(out) != size:
        raise ValueError("damaged compressed points")
    return bytes(out)


def pcd_columns(data: bytes) -> tuple[list[str], list[str], list[np.ndarray]]:
    """Names, kinds and values of the fields of a file; a field with a count has one row of values for each point."""
    head, at = pcd_header(data)
    names = head["FIELDS"]
    kinds = [t + s for t, s in zip(head["TYPE"], head["SIZE"])]
    counts = [int(c) for c in head.get("COUNT", ["1"] * len(names))]
    n = int(head["POINTS"][0])
    record = np.dtype([(f"f{i}", PCD_TYPES[k], (c,)) for i, (k, c) in enumerate(zip(kinds, counts))])
    mode = head["DATA"][0]
    if mode == "ascii":
        rows = np.array(data[at:].split(), dtype="U32").reshape(n, sum(counts)) if n else np.zeros((0, sum(counts)), "U32")
        values, col = [], 0
        for k, c in zip(kinds, counts):
            values.append(rows[:, col : col + c].astype(float).astype(PCD_TYPES[k]))
            col += c
    elif mode == "binary":
        table = np.frombuffer(data, record, n, at)
        values = [table[f"f{i}"] for i in range(len(names))]
    else:
        packed, size = struct.unpack_from("<II", data, at)
        flat, values, pos = _lzf(data[at + 8 : at + 8 + packed], size), [], 0
        for k, c in zip(kinds, counts):  # fields one after another
            values.append(np.frombuffer(flat, PCD_TYPES[k], n * c, pos).reshape(n, c))
            pos += n * c * np.dtype(PCD_TYPES[k]).itemsize
    keep = [i for i, name in enumerate(names) if name != "_"]
    return [names[i] for i in keep], [kinds[i] for i in keep], [values[i] for i in keep]


def read_pcd(spark: SparkSession, path: str) -> DataFrame:
    """Points of PCD files (ascii, binary, binary_compressed) with the fields of the first one, and `point_id` within the file. Only the first file's header reaches the driver."""
    files = spark.read.format("binaryFile").load(path)
    first = bytes(files.select(F.substring("content", 1, 1 << 20).alias("h")).first()["h"])
    head, _ = pcd_header(first)
    wanted = [(n, t + s, int(c)) for n, t, s, c in zip(head["FIELDS"], head["TYPE"], head["SIZE"], head.get("COUNT", ["1"] * len(head["FIELDS"]))) if n != "_"]
    schema = T.StructType([T.StructField("path", T.StringType()), T.StructField("point_id", T.LongType()), *(T.StructField(n, SPARK_TYPES[k] if c == 1 else T.ArrayType(SPARK_TYPES[k])) for n, k, c in wanted)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                names, _, values = pcd_columns(bytes(content.as_buffer()))
                own = dict(zip(names, values))
                n = len(values[0]) if values else 0
                out = [pa.array([path] * n, pa.string()), pa.array(np.arange(n))]
                out += [pa.array(own[name][:, 0]).cast(ARROW_TYPES[k]) if c == 1 else pa.array(own[name].tolist(), pa.list_(ARROW_TYPES[k])) for name, k, c in wanted]
                yield pa.RecordBatch.from_arrays(out, names=schema.names)

    return files.select("path", "content").mapInArrow(run, schema)


def write_pcd(points: DataFrame, fields: tuple[str, ...] = ("x", "y", "z")) -> DataFrame:
    """(part, content): one ascii PCD text for each partition, ready for a text sink."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [" ".join(f"{v:.9g}" for v in r) for b in batches for r in zip(*(c.to_pylist() for c in b.columns))]
        k = len(fields)
        head = ["VERSION 0.7", "FIELDS " + " ".join(fields), "SIZE" + " 8" * k, "TYPE" + " F" * k, "COUNT" + " 1" * k, f"WIDTH {len(rows)}", "HEIGHT 1", "VIEWPOINT 0 0 0 1 0 0 0", f"POINTS {len(rows)}", "DATA ascii"]
        yield pa.RecordBatch.from_arrays([pa.array(["\n".join([*head, *rows]) + "\n"])], names=["content"])

    return points.select(*(F.col(f).cast("double") for f in fields)).mapInArrow(run, "content string")


def read_stl(spark: SparkSession, path: str) -> DataFrame:
    """Triangles (path, face_id, nx..nz, x0..z2) of STL files, binary or text."""
    names = ["nx", "ny", "nz", *(f"{c}{i}" for i in range(3) for c in "xyz")]
    schema = "path string, face_id long, " + ", ".join(f"{n} float" for n in names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                data = bytes(content.as_buffer())
                n = struct.unpack_from("<I", data, 80)[0] if len(data) >= 84 else 0
                if len(data) == 84 + 50 * n and len(data) >= 84:
                    v = np.frombuffer(data, np.dtype([("v", "<f4", 12), ("a", "<u2")]), n, 84)["v"]
                else:
                    words = data.decode("ascii", "replace").split()
                    found = [float(words[i + j]) for i, w in enumerate(words) if w in ("normal", "vertex") for j in (1, 2, 3)]
                    v = np.array(found, "<f4").reshape(-1, 12)
                yield pa.RecordBatch.from_arrays([pa.array([path] * len(v), pa.string()), pa.array(np.arange(len(v))), *(pa.array(v[:, j].copy()) for j in range(12))], names=["path", "face_id", *names])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, schema)


def indexed(triangles: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Vertices and faces of a triangle soup; equal corners become one vertex, numbered by a hash of its coordinates."""
    soup = triangles.select("face_id", F.posexplode(F.array(*(F.struct(*(F.col(f"{c}{i}").alias(c) for c in "xyz")) for i in range(3)))).alias("k", "p"))
    own = soup.select("face_id", "k", "p.*", F.xxhash64("p.x", "p.y", "p.z").alias("id"))
    vertices = own.select("id", "x", "y", "z").dropDuplicates(["id"])
    faces = own.groupBy("face_id").agg(*(F.max(F.when(F.col("k") == i, F.col("id"))).alias(f"v{i}") for i in range(3)))
    return vertices, faces


def _numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(path, n, line): the lines of each file in order; a file is the unit of a task."""
    whole = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.split("value", r"\r?\n").alias("lines"))
    return whole.select("path", F.posexplode("lines").alias("n", "line"))


def _fans(polygons: DataFrame) -> DataFrame:
    """(path, face_id, v0, v1, v2): polygons (path, face, i) as fans of triangles, numbered from 0 in each file."""
    triangles = F.greatest(F.size("i") - 2, F.lit(0))
    before = F.sum(triangles).over(Window.partitionBy("path").orderBy("face")) - triangles
    fans = polygons.withColumn("before", before).filter(F.size("i") > 2).select("path", "before", "i", F.explode(F.sequence(F.lit(1), F.size("i") - 2)).alias("k"))
    return fans.select("path", (F.col("before") + F.col("k") - 1).cast("long").alias("face_id"), F.col("i")[0].alias("v0"), F.expr("i[k]").alias("v1"), F.expr("i[k + 1]").alias("v2"))


def read_obj(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Vertices (path, id, x, y, z) and triangles (path, face_id, v0, v1, v2) of OBJ files; polygons become fans, negative indices count back."""
    lines = _numbered_lines(spark, path).withColumn("w", F.split(F.trim("line"), r"\s+"))
    w = Window.partitionBy("path").orderBy("n")
    v = lines.filter("w[0] = 'v'").select("path", (F.row_number().over(w) - 1).cast("long").alias("id"), *(F.col("w")[i + 1].cast("double").alias(c) for i, c in enumerate("xyz")))
    seen = lines.filter("w[0] in ('v', 'f')").withColumn("before", F.sum(F.when(F.col("w")[0] == "v", 1).otherwise(0)).over(w))
    f = seen.filter("w[0] = 'f'").withColumn("i", F.expr("transform(slice(w, 2, size(w) - 1), t -> cast(split(t, '/')[0] as bigint))"))
    f = f.withColumn("i", F.expr("transform(i, t -> if(t < 0, before + t, t - 1))")).withColumn("face", F.row_number().over(w) - 1)
    return v, _fans(f)


def read_ply(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Vertices (path, id, x, y, z) and triangles (path, face_id, v0, v1, v2) of text PLY files whose vertices begin with x, y, z."""
    lines = _numbered_lines(spark, path).withColumn("w", F.split(F.trim("line"), r"\s+"))
    head = lines.groupBy("path").agg(F.max(F.when(F.trim("line") == "end_header", F.col("n"))).alias("end"), F.max(F.regexp_extract("line", r"^element vertex (\d+)", 1).try_cast("int")).alias("vertices"), F.max(F.regexp_extract("line", r"^element face (\d+)", 1).try_cast("int")).alias("faces"))
    body = lines.join(head, "path").withColumn("k", F.col("n") - F.col("end") - 1).filter("k >= 0")
    v = body.filter("k < vertices").select("path", F.col("k").cast("long").alias("id"), *(F.col("w")[i].cast("double").alias(c) for i, c in enumerate("xyz")))
    f = body.filter("k >= vertices AND k < vertices + coalesce(faces, 0)").select("path", (F.col("k") - F.col("vertices")).cast("long").alias("face"), F.expr("transform(slice(w, 2, cast(w[0] as int)), t -> cast(t as bigint))").alias("i"))
    return v, _fans(f)


def read_xyz(spark: SparkSession, path: str, names: tuple[str, ...] = ("x", "y", "z")) -> DataFrame:
    """Points of a text file with columns split by white space; lines that are too short or no numbers are left out. Splittable."""
    w = F.split(F.trim("value"), r"\s+")
    out = spark.read.text(path).select(*(F.get(w, F.lit(i)).try_cast("double").alias(n) for i, n in enumerate(names)))
    return out.dropna()


def read_contour(spark: SparkSession, path: str) -> DataFrame:
    """(path, nth, x, y, z, fx, fy, fz): measured points of coordinate-machine files: lines `x X Y Z`, each followed by its `kraft` direction."""
    lines = _numbered_lines(spark, path).withColumn("w", F.split(F.trim("line"), r"\s+"))
    w = Window.partitionBy("path").orderBy("n")
    held = lines.filter("w[0] in ('x', 'kraft')").withColumn("next", F.lead("w").over(w))
    points = held.filter("w[0] = 'x'").withColumn("nth", F.row_number().over(w) - 1)
    force = F.when(F.col("next")[0] == "kraft", F.col("next"))
    return points.select("path", "nth", *(F.col("w")[i + 1].cast("double").alias(c) for i, c in enumerate("xyz")), *(force[i + 1].cast("double").alias(f"f{c}") for i, c in enumerate("xyz")))
