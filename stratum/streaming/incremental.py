"""Structured Streaming: ledgers that grow with files, and windowed counts of events.

An addition of this library. Counts and bytes are additive, so they update as
files arrive; digests and compressed sizes of ordered streams are not and stay
with the batch operators.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def running_ledger(files: DataFrame) -> DataFrame:
    """file_count and original_bytes by corpus and language of a stream of files (update or complete mode)."""
    known = files.where(F.col("language").isNotNull())
    return known.groupBy("corpus", "language").agg(F.count("*").alias("file_count"), F.sum("size").alias("original_bytes"))


def event_windows(events: DataFrame, size: str = "1 hour", late: str = "1 day") -> DataFrame:
    """Counts and values of events by tumbling window and type; rows later than ``late`` are dropped."""
    windows = events.withWatermark("ts", late).groupBy(F.window("ts", size), "event_type")
    found = windows.agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return found.select(F.col("window.start").alias("begin"), "event_type", "n", "total")


def all_available(stream: DataFrame, checkpoint: str, mode: str = "complete") -> DataFrame:
    """Run a stream over what is there now; its result as a table in memory (small results only)."""
    name = f"stream_{uuid.uuid4().hex}"
    query = (
        stream.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )
    query.awaitTermination()
    return stream.sparkSession.table(name)
