"""An extension of ours: cache upkeep as a stream. The catalog itself has no streaming operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def activity(reads: DataFrame, ttl: str = "7 days", window: str = "1 day", at: str = "ts", key: str = "cache_key") -> DataFrame:
    """Reads of each entry by window, with the last one; rows later than the time-to-live are
    dropped by the watermark, which also bounds the state."""
    return reads.withWatermark(at, ttl).groupBy(F.window(at, window), key).agg(F.count("*").alias("reads"), F.max(at).alias("last_read"))


def first_seen(events: DataFrame, ttl: str = "7 days", at: str = "ts", key: str = "event_id") -> DataFrame:
    """Each key once within the time-to-live: last-write logs that repeat entries are passed on once."""
    return events.withWatermark(at, ttl).dropDuplicatesWithinWatermark([key])
