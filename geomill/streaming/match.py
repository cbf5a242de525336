"""Nearest-time matching of two streams and change detection between frames."""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator
from functools import reduce
from operator import and_

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from geomill.functions.time import micros


#: Microseconds of a slab of time: a window partition holds one group's rows of one slab.
SLAB_US = 86_400_000_000


def nearest_time(left: DataFrame, right: DataFrame, by: list[str], time: str = "ts", key: str = "event_id", slab_us: int = SLAB_US) -> DataFrame:
    """(by, left id, right id, gap_us): for each left row the right row nearest in time within its group; a tie keeps the earlier one, then the one of least id.

    Both sides are laid in one sequence, cut into slabs of time, where the last right row
    before and the first one after are window functions; a slab knows the last right row of
    the earlier slabs and the first of the later ones. So a busy group is spread over its
    slabs, and there is no range join.
    """
    side = lambda df, is_left: df.select(*by, micros(F.col(time)).alias("t"), F.col(key).alias("k"), F.lit(is_left).alias("is_left"))
    once = side(right, False).groupBy(*by, "t", "is_left").agg(F.min("k").alias("k"))
    every = side(left, True).unionByName(once)
    every = every.withColumn("slab", F.floor(F.col("t") / slab_us))
    other = F.when(~F.col("is_left"), F.struct("t", "k"))
    ends = every.groupBy(*by, "slab").agg(F.max(other).alias("end"), F.min(other).alias("begin"))
    slabs = Window.partitionBy(*by).orderBy("slab")
    carried = ends.select(*by, "slab", F.last("end", ignorenulls=True).over(slabs.rowsBetween(Window.unboundedPreceding, -1)).alias("earlier"), F.first("begin", ignorenulls=True).over(slabs.rowsBetween(1, Window.unboundedFollowing)).alias("later"))
    same = [F.col(f"e.{c}").eqNullSafe(F.col(f"c.{c}")) for c in [*by, "slab"]]
    every = every.alias("e").join(carried.alias("c"), reduce(and_, same)).select("e.*", "earlier", "later")
    w = Window.partitionBy(*by, "slab").orderBy("t", "is_left", "k")
    before = F.coalesce(F.last(other, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.col("earlier"))
    after = F.coalesce(F.first(other, ignorenulls=True).over(w.rowsBetween(1, Window.unboundedFollowing)), F.col("later"))
    m = every.withColumns({"before": before, "after": after}).filter("is_left")
    gap_b, gap_a = F.col("t") - F.col("before.t"), F.col("after.t") - F.col("t")
    pick_b = F.col("before").isNotNull() & (F.col("after").isNull() | (gap_b <= gap_a))
    return m.select(*by, F.col("k").alias("left_id"), F.when(pick_b, F.col("before.k")).otherwise(F.col("after.k")).alias("right_id"), F.when(pick_b, gap_b).otherwise(gap_a).alias("gap_us"))


def stream_match(events: DataFrame, key: str, side: str, watermark: str = "10 minutes", patience_ms: int = 600_000, unmatched: bool = False) -> DataFrame:
    """Streaming form on (key, side 0/1, ts, event_id): a left row is published once a right row at or after it bounds the match.

    If none comes until the watermark has passed the last batch's by `patience_ms`, it is
    published with the last right row before it; if there is none it is left out, or with
    `unmatched` published with nulls, as the batch form does. Rows older
    than the watermark are not waited for. Of right rows at one time the least id counts.
    """

    def step(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        left, right = state.get if state.exists else ([], [])
        left, right = [tuple(v) for v in left], {t: i for t, i in right}
        for f in frames:
            for is_right, t, i in zip(f[side].tolist(), (f["ts"].astype("int64") // 1000).tolist(), f["event_id"].tolist()):
                if is_right:
                    right[t] = min(i, right.get(t, i))
                else:
                    left.append((t, i))
        left.sort()
        times = sorted(right)
        out, wait = [], []
        for t, i in left:
            at = bisect_left(times, t)
            if at == len(times) and not state.hasTimedOut:
                wait.append((t, i))
                continue
            near = min(times[max(at - 1, 0) : at + 1], key=lambda r: (abs(r - t), r), default=None)
            if near is not None:
                out.append((k[0], i, right[near], abs(near - t)))
            elif unmatched:
                out.append((k[0], i, None, None))
        if state.hasTimedOut:
            state.remove()
        else:
            # What a later left row can still need: the last right row before the first that waits, and all after it.
            floor = wait[0][0] if wait else (times[-1] if times else 0)
            held = times[max(bisect_left(times, floor) - 1, 0) :]
            state.update(([list(v) for v in wait], [[t, right[t]] for t in held]))
            state.setTimeoutTimestamp(max(state.getCurrentWatermarkMs(), 0) + patience_ms)
        yield pd.DataFrame(out, columns=[key, "left_id", "right_id", "gap_us"]).astype({"right_id": "Int64", "gap_us": "Int64"})

    kind = dict(events.dtypes)[key]
    return events.withWatermark("ts", watermark).groupBy(key).applyInPandasWithState(step, f"{key} {kind}, left_id long, right_id long, gap_us long", "left array<array<long>>, right array<array<long>>", "append", GroupStateTimeout.EventTimeTimeout)


def gaps(events: DataFrame, by: list[str], time: str = "ts", key: str = "event_id", slab_us: int = SLAB_US) -> DataFrame:
    """(by, key, t, gap): microseconds from each event to the one before in its group (by time, then key); null for the first. Slabs carry their last time on."""
    e = events.select(*by, key, micros(F.col(time)).alias("t")).withColumn("slab", F.floor(F.col("t") / slab_us))
    ends = e.groupBy(*by, "slab").agg(F.max("t").alias("end"))
    carried = ends.select(*by, "slab", F.lag("end").over(Window.partitionBy(*by).orderBy("slab")).alias("earlier"))
    same = [F.col(f"e.{c}").eqNullSafe(F.col(f"c.{c}")) for c in [*by, "slab"]]
    e = e.alias("e").join(carried.alias("c"), reduce(and_, same)).select("e.*", "earlier")
    before = F.coalesce(F.lag("t").over(Window.partitionBy(*by, "slab").orderBy("t", key)), F.col("earlier"))
    return e.select(*by, key, "t", (F.col("t") - before).alias("gap"))


def changes(frames: DataFrame, frame: str, cell: list[str]) -> DataFrame:
    """(frame, cell): cells occupied in a frame but not in the one before. Frames are consecutive whole numbers."""
    now = frames.select(F.col(frame).cast("long").alias(frame), *cell).distinct()
    shifted = now.select((F.col(frame) + 1).alias(frame), *cell)
    return now.join(shifted, [frame, *cell], "left_anti")


def running_histogram(stream: DataFrame, value: str, width: float, time: str = "ts", window: str = "1 day", watermark: str = "1 hour") -> DataFrame:
    """(start, bin, n): counts of value bins in tumbling windows; the same on a stream (update or append mode) and on a table."""
    if stream.isStreaming:
        stream = stream.withWatermark(time, watermark)
    return stream.groupBy(F.window(time, window).alias("w"), F.floor(F.col(value) / width).alias("bin")).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), "bin", "n")
