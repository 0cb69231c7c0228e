"""Window statistics of unbounded event streams. An extension: the batch windows hop from each record's own
start, which a stream cannot know; these lie on the epoch's grid."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def window_stats(events: DataFrame, record: str, ts: str, value: str, length: str, stride: str | None = None, late: str = "10 minutes") -> DataFrame:
    """Count, mean, deviation, least and greatest value of each record and window; works on a stream (events
    up to ``late`` behind still count, state behind that is dropped) and on a table."""
    if events.isStreaming:
        events = events.withWatermark(ts, late)
    w = F.window(ts, length, stride) if stride else F.window(ts, length)
    found = events.groupBy(F.col(record).alias("record_id"), w.alias("w")).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"), F.min(value).alias("min"), F.max(value).alias("max"))
    return found.select("record_id", F.col("w.start").alias("w_start"), F.col("w.end").alias("w_end"), "n", "mean", "std", "min", "max")


def sessions(events: DataFrame, record: str, ts: str, gap: str, late: str = "10 minutes") -> DataFrame:
    """Events of a record with less than ``gap`` between them, as one session."""
    if events.isStreaming:
        events = events.withWatermark(ts, late)
    found = events.groupBy(F.col(record).alias("record_id"), F.session_window(ts, gap).alias("w")).agg(F.count(F.lit(1)).alias("n"))
    return found.select("record_id", F.col("w.start").alias("s_start"), F.col("w.end").alias("s_end"), "n")
