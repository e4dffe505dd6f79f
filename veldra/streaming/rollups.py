"""Streams: ingest of new texts and rollups of events, with late data bounded by watermarks."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from veldra.functions import text as T
from veldra.operators import chunking as C


def tumbling(events: DataFrame, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """``window_start, event_type, events, value`` by event time; rows later than ``late`` are dropped."""
    e = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    out = e.groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("events"), F.round(F.sum("value"), 4).alias("value"))
    return out.select(F.col("window.start").alias("window_start"), "event_type", "events", "value")


def user_sessions(events: DataFrame, gap: str = "30 minutes", late: str = "2 hours") -> DataFrame:
    """``user_id, session_start, session_end, events``: a session ends after ``gap`` without an event."""
    e = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    out = e.groupBy(F.session_window("ts", gap), "user_id").agg(F.count("*").alias("events"))
    return out.select("user_id", F.col("session_window.start").alias("session_start"), F.col("session_window.end").alias("session_end"), "events")


def new_contents(docs: DataFrame, late: str = "1 day") -> DataFrame:
    """Documents whose text wasn't seen within the watermark, with its hash."""
    d = docs.withColumn("at", F.col("ingestion_date").cast("timestamp")).withColumn("text_hash", F.sha2(F.coalesce("text", F.lit("")), 256))
    return d.withWatermark("at", late).dropDuplicatesWithinWatermark(["text_hash"])


def ingest(docs: DataFrame, path: str, checkpoint: str, size: int = 100, overlap: int = 20):
    """Start a query that chunks each micro-batch of new texts and appends the chunks by document."""

    def write(batch: DataFrame, number: int) -> None:
        cleaned = batch.select("doc_id", T.sanitize_whitespace(F.col("text")).alias("text"))
        C.window_chunks(cleaned, "doc_id", "text", size, overlap).withColumn("batch", F.lit(number)).write.mode("append").parquet(path)

    return new_contents(docs).writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
