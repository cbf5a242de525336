import pytest
from pyspark.sql import functions as F
from pyspark.sql.datasource import EqualTo, GreaterThanOrEqual, LessThan

from geomill.operators import voxel
from geomill.sources import pyramid, volumes


@pytest.fixture(scope="module")
def written(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("p") / "pyramid")
    v = volumes.implicit(spark, 21)
    levels = voxel.pyramid(v, 3).persist()
    pyramid.write(levels, path, size=8, files=5)
    return path, v, levels


def test_round_trip(spark, written):
    path, _, levels = written
    got = pyramid.read(spark, path)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, levels.select("level", "x", "y", "z", "gray").collect()))


def test_footers_hold_histogram_and_nodes(spark, written):
    path, v, levels = written
    assert sorted(map(tuple, pyramid.histogram(spark, path).collect())) == sorted(map(tuple, v.groupBy("gray").count().collect()))
    tiled = levels.groupBy("level", *((F.floor(F.col(c) / 8)).cast("int").alias(f"t{c}") for c in "xyz")).agg(F.min("gray").alias("lo"), F.max("gray").alias("hi"))
    want = sorted(map(tuple, tiled.collect()))
    nodes = pyramid.read(spark, path, "nodes")
    assert sorted(map(tuple, nodes.select("level", "tx", "ty", "tz", "lo", "hi").collect())) == want
    assert nodes.filter("w = 5 AND h = 8 AND level = 0").count() == 6


def _read(path, *filters):
    reader = pyramid.Reader(path, "voxels")
    assert list(reader.pushFilters(list(filters))) == list(filters)
    parts = reader.partitions()
    rows = [r for p in parts for b in reader.read(p) for r in zip(*(c.to_pylist() for c in b.columns))]
    return rows, len(parts), reader.tiles_read


def test_a_region_at_a_level_reads_only_its_tiles(written):
    path, _, levels = written
    every = [tuple(r) for r in levels.select("level", "x", "y", "z", "gray").collect()]
    rows, files, tiles = _read(path)
    assert (files, tiles) == (5, 27 + 8 + 1) and sorted(rows) == sorted(every)
    rows, files, tiles = _read(path, EqualTo(("level",), 0), GreaterThanOrEqual(("x",), 9), LessThan(("x",), 12), LessThan(("y",), 8), GreaterThanOrEqual(("z",), 8), LessThan(("z",), 16))
    assert tiles == 1 and files < 5
    assert sorted(rows) == sorted(r for r in every if r[0] == 0 and 9 <= r[1] < 12 and r[2] < 8 and 8 <= r[3] < 16)
    rows, files, tiles = _read(path, EqualTo(("level",), 2))
    assert tiles == 1 and len(rows) == 6**3
    top = max(r[4] for r in every)
    rows, _, tiles = _read(path, GreaterThanOrEqual(("gray",), top))
    assert 0 < tiles < 10 and sorted(rows) == sorted(r for r in every if r[4] == top)


def test_filters_reach_the_reader(spark, written):
    path, _, levels = written
    where = "level = 1 AND x >= 8 AND y < 3 AND gray > 0"
    df = pyramid.read(spark, path).filter(where)
    assert sorted(map(tuple, df.collect())) == sorted(map(tuple, levels.select("level", "x", "y", "z", "gray").filter(where).collect()))
    # Files of other levels have no task.
    assert df.rdd.getNumPartitions() < 5


def test_a_second_write_replaces_the_manifest(spark, tmp_path):
    path = str(tmp_path / "p")
    for n in (3, 4):
        pyramid.write(voxel.pyramid(volumes.implicit(spark, n), 1), path, size=2)
        assert pyramid.read(spark, path).count() == n**3
    pyramid.write(voxel.pyramid(volumes.implicit(spark, 3), 1).limit(0), path, size=2)
    assert pyramid.read(spark, path).count() == 0
