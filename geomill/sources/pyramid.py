"""Tiled volume pyramids as a Spark data source, `voxel_pyramid`.

A pyramid is a folder of part files and a small manifest. A part file holds compressed tiles
one after the other and ends with a footer: a node for each tile (level, place, extent,
least and largest gray, where its bytes are) and the histogram of its voxels of level 0. Tasks write
part files of their own; the manifest names those of the tasks that were committed, with
the ranges their tiles lie in, so nothing for each tile or voxel reaches the driver.

A read is planned from the manifest: files outside the ranges that the filters ask for have no
partition. A task reads the footer of its file and then only the byte ranges of tiles that can
hold a row: by level, by place and by gray. Filters reach the reader when
`spark.sql.python.filterPushdown.enabled` is set (`register` sets it); Spark applies
them to the rows again.

    write(voxel.pyramid(volume, 4), path)
    register(spark).read.format("voxel_pyramid").load(path).filter("level = 2 AND x < 40")

Option `kind`: `voxels` (level, x, y, z, gray), `nodes` (a row for each tile, without its
voxels) or `histogram` (gray, n of level 0, to be summed over files). Paths are those of
pyarrow's file systems: local or mounted folders, s3, gs, hdfs.
"""

from __future__ import annotations

import json
import uuid
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow.fs import FileSystem, FileType
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual, WriterCommitMessage
from pyspark.sql.types import StructType

AXES = ("x", "y", "z")
NODES = ("level", "tx", "ty", "tz", "w", "h", "d", "lo", "hi", "offset", "length")
SCHEMAS = {
    "voxels": "level int, x int, y int, z int, gray int",
    "nodes": "file string, " + ", ".join(f"{c} {'long' if c in ('offset', 'length') else 'int'}" for c in NODES),
    "histogram": "gray int, n long",
}
#: Fixed by the format of the parts: the last bytes are the footer's length.
TAIL_BYTES = 8
MANIFEST = "manifest.json"


def _place(path: str) -> tuple[FileSystem, str]:
    return FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else FileSystem.from_uri("file://" + path)


def tiles(levels: DataFrame, size: int) -> DataFrame:
    """(level, tx, ty, tz, w, h, d, lo, hi, data): dense tiles of (level, x, y, z, gray) in raster order; voxels that are missing inside a tile's extent are 0. A group holds one tile."""

    def pack(table: pa.Table) -> pa.Table:
        level, x, y, z, g = (table.column(c).to_numpy() for c in ("level", *AXES, "gray"))
        at = [c % size for c in (x, y, z)]
        w, h, d = (int(c.max()) + 1 for c in at)
        out = np.zeros((d, h, w), "<u2")
        out[at[2], at[1], at[0]] = g
        row = [int(level[0]), *(int(c[0]) // size for c in (x, y, z)), w, h, d, int(out.min()), int(out.max())]
        return pa.table([*(pa.array([v], pa.int32()) for v in row), pa.array([zlib.compress(out.tobytes(), 1)])], names=[*NODES[:9], "data"])

    keyed = levels.select("level", *AXES, "gray", *(F.floor(F.col(c) / size).cast("int").alias(f"t{c}") for c in AXES))
    return keyed.groupBy("level", "tx", "ty", "tz").applyInArrow(pack, ", ".join(f"{c} int" for c in NODES[:9]) + ", data binary")


@dataclass
class Part(InputPartition):
    file: str

    def __init__(self, file: str):
        self.file = file


@dataclass
class Wrote(WriterCommitMessage):
    """A part file and the least and largest level and tile places in it."""

    file: str
    rows: int
    low: list[int]
    high: list[int]


class Writer(DataSourceArrowWriter):
    def __init__(self, path: str, size: int):
        self.path, self.size = path, size

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Wrote:
        fs, folder = _place(self.path)
        fs.create_dir(folder, recursive=True)
        name = f"part-{uuid.uuid4().hex}.tiles"
        nodes, counts, at = [], np.zeros(1 << 16, np.int64), 0
        with fs.open_output_stream(f"{folder}/{name}") as out:
            for batch in iterator:
                for row in zip(*(c.to_pylist() for c in batch.columns)):
                    *node, data = row
                    out.write(data)
                    nodes.append((*node, at, len(data)))
                    at += len(data)
                    if node[0] == 0:
                        counts += np.bincount(np.frombuffer(zlib.decompress(data), "<u2"), minlength=1 << 16)
            table = np.array(nodes, "<i8").reshape(-1, len(NODES))
            gray = np.flatnonzero(counts)
            footer = b"".join(np.array(v, "<i8").tobytes() for v in (len(table), len(gray), table, gray, counts[gray]))
            out.write(footer)
            out.write(len(footer).to_bytes(TAIL_BYTES, "little"))
        if not nodes:
            fs.delete_file(f"{folder}/{name}")
            return Wrote("", 0, [], [])
        return Wrote(name, len(nodes), table[:, :4].min(axis=0).tolist(), table[:, :4].max(axis=0).tolist())

    def commit(self, messages: list[Wrote | None]) -> None:
        fs, folder = _place(self.path)
        parts = [{"file": m.file, "tiles": m.rows, "low": m.low, "high": m.high} for m in messages if m and m.rows]
        fs.create_dir(folder, recursive=True)
        with fs.open_output_stream(f"{folder}/{MANIFEST}") as out:
            out.write(json.dumps({"tile": self.size, "parts": parts}).encode())

    def abort(self, messages: list[Wrote | None]) -> None:
        fs, folder = _place(self.path)
        for m in messages:
            if m and m.file and fs.get_file_info(f"{folder}/{m.file}").type == FileType.File:
                fs.delete_file(f"{folder}/{m.file}")


class Reader(DataSourceReader):
    def __init__(self, path: str, kind: str):
        self.path, self.kind = path, kind
        self.low = {c: -np.inf for c in ("level", *AXES, "gray")}
        self.high = {c: np.inf for c in ("level", *AXES, "gray")}
        self.tiles_read = 0

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        """Bounds of columns narrow what is read; all filters are left to Spark too."""
        for f in filters:
            c = f.attribute[0] if hasattr(f, "attribute") and len(f.attribute) == 1 else None
            if self.kind == "voxels" and c in self.low and isinstance(getattr(f, "value", None), int):
                if isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual)):
                    self.low[c] = max(self.low[c], f.value + isinstance(f, GreaterThan))
                if isinstance(f, (EqualTo, LessThan, LessThanOrEqual)):
                    self.high[c] = min(self.high[c], f.value - isinstance(f, LessThan))
            yield f

    def _manifest(self) -> dict:
        fs, folder = _place(self.path)
        with fs.open_input_stream(f"{folder}/{MANIFEST}") as f:
            return json.loads(f.read())

    def partitions(self) -> list[Part]:
        """A partition for each file whose ranges meet the bounds."""
        m = self._manifest()
        names = ("level", *AXES)
        meets = lambda p: all(p["high"][i] * w + w - 1 >= self.low[c] and p["low"][i] * w <= self.high[c] for i, (c, w) in enumerate(zip(names, (1, *[m["tile"]] * 3))))
        return [Part(p["file"]) for p in m["parts"] if meets(p)]

    def read(self, partition: Part | None) -> Iterator[pa.RecordBatch]:
        if partition is None:  # what Spark asks for when there are no partitions
            return
        fs, folder = _place(self.path)
        size = self._manifest()["tile"]
        with fs.open_input_file(f"{folder}/{partition.file}") as f:
            end = f.size() - TAIL_BYTES
            footer = int.from_bytes(f.read_at(TAIL_BYTES, end), "little")
            v = np.frombuffer(f.read_at(footer, end - footer), "<i8")
            n, k = int(v[0]), int(v[1])
            nodes, gray, count = v[2 : 2 + n * len(NODES)].reshape(n, len(NODES)), v[len(v) - 2 * k : len(v) - k], v[len(v) - k :]
            if self.kind == "histogram":
                yield pa.RecordBatch.from_arrays([pa.array(gray, pa.int32()), pa.array(count, pa.int64())], names=["gray", "n"])
            elif self.kind == "nodes":
                kinds = [pa.int64() if c in ("offset", "length") else pa.int32() for c in NODES]
                yield pa.RecordBatch.from_arrays([pa.array([partition.file] * n, pa.string()), *(pa.array(nodes[:, i], t) for i, t in enumerate(kinds))], names=["file", *NODES])
            else:
                for node in nodes[self._wanted(nodes, size)]:
                    yield from self._voxels(f, dict(zip(NODES, node.tolist())), size)

    def _wanted(self, nodes: np.ndarray, size: int) -> np.ndarray:
        col = {c: nodes[:, i] for i, c in enumerate(NODES)}
        meets = (col["level"] >= self.low["level"]) & (col["level"] <= self.high["level"]) & (col["hi"] >= self.low["gray"]) & (col["lo"] <= self.high["gray"])
        for c, t, w in zip(AXES, ("tx", "ty", "tz"), ("w", "h", "d")):
            meets &= (col[t] * size + col[w] - 1 >= self.low[c]) & (col[t] * size <= self.high[c])
        return np.flatnonzero(meets)

    def _voxels(self, f: pa.NativeFile, node: dict, size: int) -> Iterator[pa.RecordBatch]:
        self.tiles_read += 1
        w, h, d = node["w"], node["h"], node["d"]
        gray = np.frombuffer(zlib.decompress(f.read_at(node["length"], node["offset"])), "<u2")
        i = np.arange(w * h * d, dtype=np.int32)
        place = {"x": i % w + node["tx"] * size, "y": i // w % h + node["ty"] * size, "z": i // (w * h) + node["tz"] * size, "gray": gray.astype(np.int32)}
        inside = np.ones(len(i), bool)
        for c, v in place.items():
            inside &= (v >= self.low[c]) & (v <= self.high[c])
        columns = [np.full(len(i), node["level"], np.int32), *place.values()]
        yield pa.RecordBatch.from_arrays([pa.array(v[inside], pa.int32()) for v in columns], names=["level", *AXES, "gray"])


class VoxelPyramid(DataSource):
    @classmethod
    def name(cls) -> str:
        return "voxel_pyramid"

    def schema(self) -> str:
        return SCHEMAS[self.options.get("kind", "voxels")]

    def reader(self, schema: StructType) -> Reader:
        return Reader(self.options["path"], self.options.get("kind", "voxels"))

    def writer(self, schema: StructType, overwrite: bool) -> Writer:
        return Writer(self.options["path"], int(self.options["tile"]))


def register(spark: SparkSession) -> SparkSession:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(VoxelPyramid)
    return spark


def write(levels: DataFrame, path: str, size: int = 64, files: int = 8) -> None:
    """Write (level, x, y, z, gray) as a pyramid: files take ranges of (level, tz, ty, tx), so a region is few of them."""
    register(levels.sparkSession)
    order = ("level", "tz", "ty", "tx")
    tiles(levels, size).repartitionByRange(files, *order).sortWithinPartitions(*order).write.format("voxel_pyramid").option("tile", size).mode("append").save(path)


def read(spark: SparkSession, path: str, kind: str = "voxels") -> DataFrame:
    return register(spark).read.format("voxel_pyramid").option("kind", kind).load(path)


def histogram(spark: SparkSession, path: str) -> DataFrame:
    """(gray, n) of level 0, from the footers alone."""
    return read(spark, path, "histogram").groupBy("gray").agg(F.sum("n").alias("n"))
