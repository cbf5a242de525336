"""Keyed state on streams of voxels: cells that are new in a frame, and a volume that cells leave when their time is over.

Both have a batch form with the same rows. State is kept for each cell and timers follow
the watermark, so results don't depend on how rows are dealt to batches as long as they
come within the watermark's delay. The session needs the RocksDB state store
(`use_state_store`).
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from operator import and_
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from geomill.functions.time import micros
from geomill.streaming.match import SLAB_US


def use_state_store(spark: SparkSession) -> None:
    """Transforming state needs a store that holds several states and timers for a key."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def _keyed(rows: DataFrame, cell: list[str], processor: StatefulProcessor, given: str) -> DataFrame:
    """The processor's rows for each cell. The key is the cell's text, because keys with nulls aren't told apart from each other by the state's Python side."""
    kinds = ", ".join(f"`{c}` {dict(rows.dtypes)[c]}" for c in cell)
    keyed = rows.withColumn("key", F.to_json(F.struct(*cell), {"ignoreNullFields": "false"}))
    out = keyed.groupBy("key").transformWithStateInPandas(processor, f"key string, {given}", "Append", "EventTime")
    return out.withColumn("cell", F.from_json("key", kinds)).select("cell.*", *(c for c in out.columns if c != "key"))


class NewCells(StatefulProcessor):
    """State of a cell: frames it was seen in that the watermark hasn't passed, and the last one that it has."""

    def __init__(self, length_ms: int):
        self.length = length_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.pending = handle.getMapState("pending", "frame long", "seen boolean")
        self.last = handle.getValueState("last", "frame long")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        for f in rows:
            for frame in f["frame"].unique().tolist():
                if not self.pending.containsKey((frame,)):
                    self.pending.updateValue((frame,), (True,))
                    self.handle.registerTimer((frame + 1) * self.length)
        return iter(())

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        now = expiredTimerInfo.getExpiryTimeInMs()
        last = self.last.get()[0] if self.last.exists() else None
        due = sorted(f for (f,) in self.pending.keys() if (f + 1) * self.length <= now)
        new = []
        for f in due:
            self.pending.removeKey((f,))
            if last != f - 1:
                new.append((key[0], f))
            last = f
        if due:
            self.last.update((last,))
            self.handle.registerTimer((last + 2) * self.length)  # by then the next frame has been seen or the cell is gone
        elif last is not None and (last + 2) * self.length <= now:
            self.last.clear()
        if new:
            yield pd.DataFrame(new, columns=["key", "frame"])

    def close(self) -> None:
        pass


def stream_changes(stream: DataFrame, cell: list[str], length_ms: int, time: str = "ts", watermark: str = "10 minutes") -> DataFrame:
    """(frame, cell): cells occupied in a frame of `length_ms` but not in the one before, given when the watermark has passed the frame. A cell that is absent for a frame leaves the state."""
    rows = stream.withWatermark(time, watermark).select(time, *cell, F.floor(micros(F.col(time)) / (1000 * length_ms)).cast("long").alias("frame"))
    return _keyed(rows, cell, NewCells(length_ms), "frame long").select("frame", *cell)


class MovingVolume(StatefulProcessor):
    """State of a cell: its open visits, each (first, last, n, total)."""

    def __init__(self, stay_us: int):
        self.stay = stay_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getListState("open", "first long, last long, n long, total long")

    def _due(self, visit: tuple) -> int:
        """First whole millisecond at which nothing older can still join."""
        return (visit[1] + self.stay) // 1000 + 1

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        visits = [tuple(v) for v in self.open.get()] if self.open.exists() else []
        before = {self._due(v) for v in visits}
        for f in rows:
            visits += [(t, t, 1, v) for t, v in zip(f["t"].tolist(), f["amount"].tolist())]
        visits.sort()
        joined = visits[:1]
        for first, last, n, total in visits[1:]:
            a, b, m, s = joined[-1]
            if first - b <= self.stay:
                joined[-1] = (a, max(b, last), m + n, s + total)
            else:
                joined.append((first, last, n, total))
        self.open.put(joined)
        now = {self._due(v) for v in joined}
        for t in before - now:
            self.handle.deleteTimer(t)
        for t in now - before:
            self.handle.registerTimer(t)
        return iter(())

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        now = expiredTimerInfo.getExpiryTimeInMs()
        visits = [tuple(v) for v in self.open.get()] if self.open.exists() else []
        over, still = [v for v in visits if self._due(v) <= now], [v for v in visits if self._due(v) > now]
        if still:
            self.open.put(still)
        else:
            self.open.clear()
        if over:
            yield pd.DataFrame([(key[0], *v) for v in over], columns=["key", "first_us", "last_us", "n", "total"])

    def close(self) -> None:
        pass


def moving_volume(stream: DataFrame, cell: list[str], value: str, stay_us: int, time: str = "ts", watermark: str = "10 minutes") -> DataFrame:
    """(cell, first_us, last_us, n, total) of a cell's visit: what it summed up (whole numbers) until no row came for `stay_us`.

    The cell is then given out and leaves the state, so the state holds the cells of the last
    `stay_us` and the watermark's delay, wherever the sensor went; a cell that comes back begins a new visit.
    """
    rows = stream.withWatermark(time, watermark).select(time, *cell, micros(F.col(time)).alias("t"), F.floor(value).cast("long").alias("amount"))
    return _keyed(rows, cell, MovingVolume(stay_us), "first_us long, last_us long, n long, total long")


def visits(rows: DataFrame, cell: list[str], value: str, stay_us: int, time: str = "ts", slab_us: int = SLAB_US) -> DataFrame:
    """The batch form of `moving_volume`: slabs of time carry on the last time and the number of visits, so a busy cell is many window partitions."""
    e = rows.select(*cell, micros(F.col(time)).alias("t"), F.floor(value).cast("long").alias("amount")).groupBy(*cell, "t").agg(F.count(F.lit(1)).alias("n"), F.sum("amount").alias("total")).withColumn("slab", F.floor(F.col("t") / slab_us))
    slabs = Window.partitionBy(*cell).orderBy("slab")
    same = lambda a, b: reduce(and_, [F.col(f"{a}.{c}").eqNullSafe(F.col(f"{b}.{c}")) for c in [*cell, "slab"]])
    ends = e.groupBy(*cell, "slab").agg(F.max("t").alias("end")).withColumn("earlier", F.lag("end").over(slabs))
    e = e.alias("e").join(ends.alias("c"), same("e", "c")).select("e.*", "earlier")
    own = Window.partitionBy(*cell, "slab").orderBy("t")
    gap = F.col("t") - F.coalesce(F.lag("t").over(own), F.col("earlier"))
    e = e.withColumn("opens", (gap.isNull() | (gap > stay_us)).cast("long")).drop("earlier")
    counts = e.groupBy(*cell, "slab").agg(F.sum("opens").alias("k")).withColumn("before", F.sum("k").over(slabs) - F.col("k"))
    e = e.alias("e").join(counts.alias("c"), same("e", "c")).select("e.*", "before")
    e = e.withColumn("visit", F.col("before") + F.sum("opens").over(own))
    return e.groupBy(*cell, "visit").agg(F.min("t").alias("first_us"), F.max("t").alias("last_us"), F.sum("n").alias("n"), F.sum("total").alias("total")).drop("visit")
