"""Structured Streaming forms of the queue, the epoch log and the backlog."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphwright.sources.store import AppendOnlyTable


def idempotent_triggers(stream: DataFrame, key: str = "trigger_id", time: str = "stored_at", delay: str = "7 days") -> DataFrame:
    """Each trigger once: repeats within the watermark are dropped and their state is freed after it."""
    return stream.withWatermark(time, delay).dropDuplicatesWithinWatermark([key])


def backlog_windows(stream: DataFrame, time: str = "enqueued_at", width: str = "1 hour", delay: str = "2 hours") -> DataFrame:
    """Items per source and window; windows close ``delay`` after their end."""
    return stream.withWatermark(time, delay).groupBy(F.window(time, width), "source").agg(F.count("*").alias("depth"), F.max("value").alias("max_value"))


def publish_epochs(table: AppendOnlyTable, stream: str) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` sink that commits each batch of ``stream`` once.

    The batch id lies in the commit marker, so a batch that is delivered again,
    after a restart as well, is skipped; the epoch never goes back.
    """

    def sink(batch: DataFrame, batch_id: int) -> None:
        if batch_id > table.last_batch(stream):
            table.append(batch, stream=stream, batch=batch_id)

    return sink
