"""Raw voxel volumes: binary readers and a writer, distributed by slabs of slices."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

VOXELS = "x int, y int, z int, gray int"
#: Fixed by the raw format: the payload begins after this many bytes.
HEADER_BYTES = 1024


def read_raw(spark: SparkSession, path: str, dims: tuple[int, int, int], offset: int = HEADER_BYTES, slices: int = 8, dtype: str = "<u2") -> DataFrame:
    """Voxels of a raw volume, x fastest. Files go through Spark's binaryFile source, so any store that Spark reads will do.

    A file becomes a row of bytes once, is cut into slabs of `slices` slices, and the slabs
    are dealt out before they are unfolded into voxels. A file of over 2 GB doesn't fit such a row; cut it into files of some slices, or store it as a pyramid (`sources.pyramid`).
    """
    w, h, depth = dims
    size = np.dtype(dtype).itemsize
    plane = w * h * size

    def slabs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                data = memoryview(content.as_buffer())[offset:]
                for z in range(0, depth, slices):
                    part = bytes(data[z * plane : (z + slices) * plane])
                    if part:
                        yield pa.RecordBatch.from_arrays([pa.array([z], pa.int32()), pa.array([part], pa.binary())], names=["z0", "data"])

    raw = spark.read.format("binaryFile").load(path).select("content").mapInArrow(slabs, "z0 int, data binary")
    return unfold(raw.repartitionByRange(max(1, (depth + slices - 1) // slices), "z0"), w, h, dtype)


def unfold(slabs: DataFrame, width: int, height: int, dtype: str = "<u2") -> DataFrame:
    """(x, y, z, gray) of slabs (z0, data)."""

    def voxels(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for z0, data in zip(batch.column(0).to_pylist(), batch.column(1)):
                gray = np.frombuffer(data.as_buffer(), dtype).astype(np.int32)
                for at in range(0, len(gray), width * height):
                    part = gray[at : at + width * height]
                    i = np.arange(len(part), dtype=np.int32)
                    yield pa.RecordBatch.from_arrays([pa.array(i % width), pa.array(i // width), pa.array(np.full(len(part), z0 + at // (width * height), np.int32)), pa.array(part)], names=["x", "y", "z", "gray"])

    return slabs.select("z0", "data").mapInArrow(voxels, VOXELS)


def read_vgi(spark: SparkSession, header: str, raw: str, offset: int = 0) -> tuple[DataFrame, float]:
    """Voxels and voxel step of a volume whose text header has lines `size = w h d` and `resolution = s ...`."""
    lines = spark.read.text(header).filter(F.col("value").contains("="))
    part = F.split("value", "=", 2)
    known = lines.select(F.lower(F.trim(part[0])).alias("k"), F.trim(part[1]).alias("v")).filter("k IN ('size', 'resolution')")
    pairs = {r["k"]: r["v"] for r in known.groupBy("k").agg(F.first("v").alias("v")).collect()}
    dims = tuple(int(v) for v in pairs["size"].split()[:3])
    return read_raw(spark, raw, dims, offset), float(pairs.get("resolution", "1").split()[0])


def encode_raw(volume: DataFrame, dims: tuple[int, int, int], slices: int = 8) -> DataFrame:
    """(z0, data): slabs of little-endian 16-bit values in raster order; missing voxels are 0. A group holds one slab."""
    w, h, depth = dims

    def pack(table: pa.Table) -> pa.Table:
        x, y, z, g = (table.column(c).to_numpy() for c in ("x", "y", "z", "gray"))
        z0 = int(z[0]) // slices * slices
        n = min(slices, depth - z0)
        out = np.zeros(n * w * h, "<u2")
        out[(z - z0) * (w * h) + y * w + x] = g
        return pa.table([pa.array([z0], pa.int32()), pa.array([out.tobytes()], pa.binary())], names=["z0", "data"])

    return volume.select("x", "y", "z", "gray", F.floor(F.col("z") / slices).alias("s")).groupBy("s").applyInArrow(pack, "z0 int, data binary")


def write_tiles(volume: DataFrame, path: str, size: int = 64) -> None:
    """Tiled Parquet: partitioned by tz, sorted by tile, so that row-group statistics prune tiles."""
    tiled = volume.withColumns({f"t{c}": F.floor(F.col(c) / size).cast("int") for c in "xyz"})
    tiled.repartition("tz", "ty").sortWithinPartitions("tz", "ty", "tx", "z", "y", "x").write.partitionBy("tz").parquet(path)


def read_tiles(spark: SparkSession, path: str, low: tuple | None = None, high: tuple | None = None, size: int = 64) -> DataFrame:
    """Voxels of a tiled table inside [low, high); tile bounds prune partitions and row groups."""
    df = spark.read.parquet(path)
    if low is not None and high is not None:
        for c, a, b in zip("xyz", low, high):
            df = df.filter((F.col(f"t{c}") >= a // size) & (F.col(f"t{c}") <= (b - 1) // size) & (F.col(c) >= a) & (F.col(c) < b))
    return df.select("x", "y", "z", "gray")


def implicit(spark: SparkSession, n: int, value: str = "greatest(0, 1000 - 3 * ((x - c) * (x - c) + (y - c) * (y - c) + (z - c) * (z - c)))") -> DataFrame:
    """Voxels of an SQL expression in x, y, z and the middle c over an n ** 3 raster."""
    i = F.col("id")
    grid = spark.range(n**3).select((i % n).cast("int").alias("x"), (F.floor(i / n) % n).cast("int").alias("y"), F.floor(i / (n * n)).cast("int").alias("z"), F.lit(n // 2).alias("c"))
    return grid.select("x", "y", "z", F.expr(value).cast("int").alias("gray"))


def random_points(spark: SparkSession, n: int, side: float = 1024.0, seed: int = 0) -> DataFrame:
    return spark.range(n).select(F.col("id").alias("point_id"), *((F.rand(seed + k) * side).alias(c) for k, c in enumerate("xyz")))


def raw_bytes(gray: np.ndarray) -> bytes:
    """A raw volume with an empty header, for fixtures."""
    return struct.pack(f"<{HEADER_BYTES}x") + gray.astype("<u2").tobytes()
