"""Queries on event streams, in their batch form; the streaming forms share the same operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from geomill.functions.time import micros
from geomill.plans.registry import Registry
from geomill.plans.tables import table
from geomill.streaming import match, state

query = Registry()


@query("""WITH p AS (SELECT l.user_id, l.event_id AS left_id, r.event_id AS right_id, abs(epoch_us(l.ts) - epoch_us(r.ts)) AS gap_us, row_number() OVER (PARTITION BY l.event_id ORDER BY abs(epoch_us(l.ts) - epoch_us(r.ts)), r.ts, r.event_id) AS k
FROM events l JOIN events r ON l.user_id = r.user_id AND l.event_type = 'click' AND r.event_type = 'view') SELECT l.user_id, l.event_id AS left_id, right_id, gap_us FROM events l LEFT JOIN p ON p.left_id = l.event_id AND k = 1 WHERE l.event_type = 'click'""")
def nearest_time_match(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    return match.nearest_time(e.filter("event_type = 'click'"), e.filter("event_type = 'view'"), ["user_id"])


@query("WITH f AS (SELECT DISTINCT epoch_us(ts) // 86400000000 AS day, floor(value / 25)::BIGINT AS cell FROM events) SELECT a.day, a.cell FROM f a WHERE NOT EXISTS (SELECT 1 FROM f b WHERE b.day = a.day - 1 AND b.cell = a.cell)")
def change_detection(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select(F.floor(micros(F.col("ts")) / 86400000000).alias("day"), F.floor(F.col("value") / 25).alias("cell"))
    return match.changes(e, "day", ["cell"])


@query("SELECT date_trunc('day', ts)::TIMESTAMP AS start, floor(value / 50)::BIGINT AS bin, count(*) AS n FROM events GROUP BY 1, 2")
def windowed_histogram(spark: SparkSession, d: str) -> DataFrame:
    return match.running_histogram(table(spark, d, "events"), "value", 50)


@query("WITH l AS (SELECT *, epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id)) AS gap FROM events) SELECT user_id, count(*) AS frames, min(gap) AS least_gap, max(gap) AS largest_gap FROM l GROUP BY 1")
def frame_intervals(spark: SparkSession, d: str) -> DataFrame:
    e = match.gaps(table(spark, d, "events"), ["user_id"])
    return e.groupBy("user_id").agg(F.count(F.lit(1)).alias("frames"), F.min("gap").alias("least_gap"), F.max("gap").alias("largest_gap"))


@query("""WITH e AS (SELECT floor(value / 25)::BIGINT AS cell, epoch_us(ts) AS t, floor(value)::BIGINT AS amount FROM events),
g AS (SELECT *, coalesce(t - lag(t) OVER (PARTITION BY cell ORDER BY t) > 600000000, TRUE) AS opens FROM e),
v AS (SELECT *, sum(opens::INT) OVER (PARTITION BY cell ORDER BY t RANGE UNBOUNDED PRECEDING) AS visit FROM g)
SELECT cell, min(t) AS first_us, max(t) AS last_us, count(*) AS n, sum(amount)::BIGINT AS total FROM v GROUP BY cell, visit""")
def moving_volume(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").withColumn("cell", F.floor(F.col("value") / 25))
    return state.visits(e, ["cell"], "value", 600_000_000)
