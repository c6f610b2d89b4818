"""Incremental processing. The engine's own need is resumable work: what is done is left out. Event-time windows and stream
deduplication are extensions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def request_key(params: dict[str, Column]) -> Column:
    """A hash of the parameters, in order of name."""
    return F.sha2(F.to_json(F.struct(*[v.alias(k) for k, v in sorted(params.items())]), {"ignoreNullFields": "false"}), 256)


def pending(work: DataFrame, done: DataFrame, key: list[str]) -> DataFrame:
    """Work that has no stored result; failures are never stored, so they come again."""
    return work.join(done.select(*key).distinct(), key, "left_anti")


def windowed_counts(events: DataFrame, width: str, late: str = "1 hour") -> DataFrame:
    """start, event_type, n, total by tumbling windows; on a stream, late rows are dropped after `late`."""
    ts = F.col("ts").cast("timestamp")
    e = events.withColumn("at", ts)
    if e.isStreaming:
        e = e.withWatermark("at", late)
    g = e.groupBy(F.window("at", width).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return g.select(F.col("w.start").alias("start"), "event_type", "n", "total")


def unique_events(events: DataFrame, late: str = "1 hour") -> DataFrame:
    """Each event_id once; on a stream within the watermark."""
    if events.isStreaming:
        return events.withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", late).dropDuplicatesWithinWatermark(["event_id"])
    return events.dropDuplicates(["event_id"])
