"""Event-time operators over a bounded table; the streaming module gives the same results live."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators.templates import carried

STRETCH = 1 << 16
GAP = "30 minutes"
LATENESS = "10 minutes"


def micros(ts: Column | str) -> Column:
    """Microseconds since 1970 of a timestamp without zone."""
    return F.timestamp_diff("MICROSECOND", F.expr("timestamp_ntz'1970-01-01 00:00:00'"), F.col(ts) if isinstance(ts, str) else ts)


def sessions(events: DataFrame, gap: str = GAP) -> DataFrame:
    """user_id, start_us, n and total of every session: events of a user not ``gap`` or more apart."""
    rows = events.groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return rows.select("user_id", micros(F.col("w.start")).alias("start_us"), "n", "total")


def late_events(events: DataFrame, lateness: str = LATENESS) -> DataFrame:
    """event_type, late and n: events, in order of event_id, further behind their user's newest event
    so far than the allowed lateness. Windows hold a stretch of a user's events; the newest of earlier
    stretches is carried in."""
    rows = events.withColumn("_stretch", F.floor(F.col("event_id") / STRETCH))
    rows, before = carried(rows, F.col("ts"), F.max, F.max, by="user_id")
    own = W.partitionBy("user_id", "_stretch").orderBy("event_id").rowsBetween(W.unboundedPreceding, 0)
    newest = F.greatest(before, F.max("ts").over(own))
    rows = rows.withColumn("late", F.coalesce(F.col("ts") < newest - F.expr(f"interval {lateness}"), F.lit(False)))
    return rows.groupBy("event_type").agg(F.count_if("late").alias("late"), F.count(F.lit(1)).alias("n"))


def sliding_counts(events: DataFrame, width: str = "60 minutes", step: str = "15 minutes") -> DataFrame:
    rows = events.groupBy(F.window("ts", width, step).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"))
    return rows.select(micros(F.col("w.start")).alias("start_us"), "event_type", "n")


def tumbling_counts(events: DataFrame, width: str = "1 hour") -> DataFrame:
    rows = events.groupBy(F.window("ts", width).alias("w")).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("user_id").alias("users"))
    return rows.select(micros(F.col("w.start")).alias("start_us"), "n", "users")
