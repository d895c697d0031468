"""The calendar counts of messages as streams, with the same results as in batch once a stream has ended."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def activity(messages: DataFrame, late: str = "1 hour", window: str = "1 hour") -> DataFrame:
    """Messages and senders' distinct rows by conversation and window of ``ts``; later than ``late`` is dropped."""
    counted = messages.withWatermark("ts", late).groupBy("conversation_id", F.window("ts", window).alias("w"))
    return counted.agg(F.count("*").alias("message_count"), F.approx_count_distinct("sender").alias("senders")).select("conversation_id", F.col("w.start").alias("start"), "message_count", "senders")


def bursts(messages: DataFrame, gap: str = "5 minutes", late: str = "1 hour") -> DataFrame:
    """Runs of messages without a longer gap, as session windows."""
    run = messages.withWatermark("ts", late).groupBy("conversation_id", F.session_window("ts", gap).alias("w"))
    return run.agg(F.count("*").alias("message_count"), F.min("timestamp_ms").alias("start_ms"), F.max("timestamp_ms").alias("end_ms")).select("conversation_id", "message_count", "start_ms", "end_ms")
