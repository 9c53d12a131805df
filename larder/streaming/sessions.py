"""Sessions that end after a time without activity."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def sessions(log: DataFrame, gap: str = "4 hours", key: str = "user_id", at: str = "ts", lateness: str = "1 hour") -> DataFrame:
    """Messages, first and last activity per session, for a table or a stream.

    A stream gives a session once it is over, the watermark included.
    """
    timed = log.where(F.col(key).isNotNull()).withColumn(at, F.col(at).cast("timestamp"))
    if log.isStreaming:
        timed = timed.withWatermark(at, lateness)
    return (
        timed.groupBy(F.session_window(at, gap).alias("session"), F.col(key))
        .agg(
            F.count(F.lit(1)).alias("message_count"),
            F.min(at).alias("created_at"),
            F.max(at).alias("last_activity"),
        )
        .select(key, "message_count", "created_at", "last_activity")
    )
