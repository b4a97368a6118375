"""Datasheets as a stream: each micro-batch is extracted and appended. Batch runs don't need this."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from ..operators.extract import extract


def extract_stream(docs: DataFrame, out: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """docs is a streaming frame (material_id, text, rows); a replayed batch overwrites its own folder only."""

    def write(batch: DataFrame, number: int) -> None:
        obs, rejected = extract(batch)
        obs.write.mode("overwrite").parquet(f"{out}/observations/batch={number}")
        rejected.write.mode("overwrite").parquet(f"{out}/rejections/batch={number}")

    writer = docs.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def windowed_counts(events: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Events by type in time windows, for batch and stream alike; late rows are dropped after the watermark."""
    some = events.withWatermark("ts", late) if events.isStreaming else events
    return some.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), "event_type", "n")
