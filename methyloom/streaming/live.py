"""Structured Streaming forms: blocks as sessions, mates as a watermarked join, duplicates by state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from .batch import GAP, LATENESS


def read_files(spark: SparkSession, path: str, schema, files_per_trigger: int = 4) -> DataFrame:
    """A folder of Parquet files as a stream; ``files_per_trigger`` is the back-pressure."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def live_sessions(events: DataFrame, gap: str = GAP, lateness: str = LATENESS) -> DataFrame:
    """Sessions close when the watermark passes their end; later events are dropped and counted in the
    query's progress (numRowsDroppedByWatermark)."""
    rows = events.withWatermark("ts", lateness).groupBy("user_id", F.session_window("ts", gap).alias("w"))
    return rows.agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select("user_id", F.col("w.start").alias("start"), "n", "total")


def live_windows(events: DataFrame, width: str = "1 hour", step: str | None = None, lateness: str = LATENESS) -> DataFrame:
    rows = events.withWatermark("ts", lateness).groupBy(F.window("ts", width, step or width).alias("w"), "event_type")
    return rows.agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), "event_type", "n")


def live_pairs(reads: DataFrame, lateness: str = LATENESS) -> DataFrame:
    """Mates joined while both are within the watermark (reads: ts, qname, is_reverse, st)."""
    side = lambda r, name: reads.filter(F.col("is_reverse") == r).withWatermark("ts", lateness).select(F.col("qname").alias(f"{name}_qname"), F.col("ts").alias(f"{name}_ts"), F.col("st").alias(f"{name}_st"))
    bound = F.expr(f"fwd_qname = rev_qname and rev_ts between fwd_ts - interval {lateness} and fwd_ts + interval {lateness}")
    return side(0, "fwd").join(side(1, "rev"), bound)


def live_first_of_duplicates(reads: DataFrame, keys: list[str], lateness: str = LATENESS) -> DataFrame:
    """The first read of each key within the watermark."""
    return reads.withWatermark("ts", lateness).dropDuplicatesWithinWatermark(keys)


def live_best_of_duplicates(reads: DataFrame, lateness: str = LATENESS) -> DataFrame:
    """The best read (mapq) of each (contig, st), once the watermark is past it; ties keep the
    first. State is one row for each open key."""

    def best(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            qname, mapq, n = state.get
            state.remove()
            yield pd.DataFrame({"contig": [key[0]], "st": [key[1]], "qname": [qname], "mapq": [mapq], "n": [n]})
            return
        qname, mapq, n = state.get if state.exists else ("", -1, 0)
        newest = 0
        for frame in frames:
            n += len(frame)
            newest = max(newest, int(frame["ts"].max().timestamp() * 1000))
            top = frame.loc[frame["mapq"].idxmax()]
            if top["mapq"] > mapq:
                qname, mapq = str(top["qname"]), int(top["mapq"])
        state.update((qname, mapq, n))
        state.setTimeoutTimestamp(max(newest, state.getCurrentWatermarkMs() + 1))

    rows = reads.withWatermark("ts", lateness).groupBy("contig", "st")
    return rows.applyInPandasWithState(best, "contig string, st long, qname string, mapq long, n long", "qname string, mapq long, n long", "append", GroupStateTimeout.EventTimeTimeout)


def run_to_end(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> StreamingQuery:
    """Process all that is there, flush, and stop; files are written exactly once."""
    query = stream.writeStream.format("parquet").outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start(path)
    query.awaitTermination()
    return query
