"""Streaming deduplication of records: an extension, not part of the matching plan.

Keeps the first record of each key within the watermark; state older than it is dropped.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def first_of_key(events: DataFrame, keys: tuple[str, ...], time: str = "ts", lateness: str = "1 hour") -> DataFrame:
    """``events``: a streaming or static frame with an event time. Null keys are a key of their own."""
    if not events.isStreaming:
        return events.dropDuplicates(list(keys))
    # a watermark needs an instant; a time without zone is taken in the session's
    return events.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, lateness).dropDuplicatesWithinWatermark(list(keys))
