"""State of streams against the batch forms, whatever the order of the rows within the watermark."""

import random
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from geomill.functions.time import micros
from geomill.streaming import match, state

SCHEMA = "ts timestamp, cx long, cy long, value double"
BEGIN = datetime(2024, 1, 1, tzinfo=timezone.utc)


@pytest.fixture(scope="module")
def rows():
    """Seconds and cells, in batches that overlap in time, and a last row far behind them all."""
    rng = random.Random(4)
    out = [(t + rng.uniform(-20, 20), rng.randrange(3), rng.choice([0, None]), rng.uniform(0, 50)) for t in range(100, 1000, 4)]
    return out, [out[i : i + 45] for i in range(0, len(out), 45)] + [[(1e6, 99, 0, 0.0)]]


def _run(spark, tmp_path, batches, build):
    state.use_state_store(spark)
    source, sink = tmp_path / "in", f"s{abs(hash(str(tmp_path)))}"
    source.mkdir()
    stream = build(spark.readStream.schema(SCHEMA).parquet(str(source)))
    q = stream.writeStream.format("memory").queryName(sink).outputMode("append").option("checkpointLocation", str(tmp_path / "c"))
    sizes = []
    for i, batch in enumerate(batches):
        at = [(BEGIN + timedelta(seconds=s), *rest) for s, *rest in batch]
        spark.createDataFrame(at, SCHEMA).coalesce(1).write.mode("append").parquet(str(source))
        if i == 0:
            running = q.start()
        running.processAllAvailable()
        sizes.append(running.lastProgress["stateOperators"][0]["numRowsTotal"])
    running.stop()
    return spark.table(sink), sizes


def _frame(spark, rows):
    return spark.createDataFrame([(BEGIN + timedelta(seconds=s), *rest) for s, *rest in rows], SCHEMA)


def test_changes_are_those_of_the_batch_form(spark, tmp_path, rows):
    every, batches = rows
    got, sizes = _run(spark, tmp_path, batches, lambda s: state.stream_changes(s, ["cx", "cy"], 10_000, watermark="60 seconds"))
    frames = _frame(spark, every).withColumn("frame", F.floor(micros(F.col("ts")) / 10_000_000))
    # A null cell is a cell: the batch form compares by value, so it is named here.
    named = frames.withColumn("cy", F.coalesce("cy", F.lit(-1)))
    want = {(r.frame, r.cx, r.cy) for r in match.changes(named, "frame", ["cx", "cy"]).collect()}
    assert {(r.frame, r.cx, -1 if r.cy is None else r.cy) for r in got.collect()} == want and got.count() == len(want) > 100


@pytest.mark.parametrize("delay", [60, 5000])
def test_cells_leave_when_their_time_is_over(spark, tmp_path, rows, delay):
    every, batches = rows
    got, sizes = _run(spark, tmp_path, batches, lambda s: state.moving_volume(s, ["cx", "cy"], "value", 25_000_000, watermark=f"{delay} seconds"))
    want = sorted(map(tuple, state.visits(_frame(spark, every), ["cx", "cy"], "value", 25_000_000).collect()), key=str)
    found = sorted(map(tuple, got.collect()), key=str)
    assert found == want and len(want) > 20
    early = [r for r in found if r[3] < BEGIN.timestamp() * 1e6 + 500e6]
    assert early and sizes[-1] < max(sizes)


def test_visits_do_not_depend_on_slabs(spark, rows):
    df = _frame(spark, rows[0])
    some = [sorted(map(str, state.visits(df, ["cx", "cy"], "value", 25_000_000, slab_us=s).collect())) for s in (7_000_000, 300_000_000, 1 << 60)]
    assert some[0] == some[1] == some[2]
