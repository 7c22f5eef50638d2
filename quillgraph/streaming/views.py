"""Hourly page views as a stream: late hits within the watermark count, repeated ones don't."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def hourly(hits: DataFrame, page: str = "user_id", ts: str = "ts", event: str = "event_id", late: str = "1 hour") -> DataFrame:
    """(tstamp, page_id, num_views) of a stream of hits; a repeated ``event`` within the watermark counts once."""
    h = hits.select(F.col(ts).cast("timestamp").alias("ts"), F.col(page).alias("page_id"), F.col(event).alias("event")).withWatermark("ts", late).dropDuplicatesWithinWatermark(["event"])
    w = h.groupBy(F.window("ts", "1 hour").alias("w"), "page_id").agg(F.count("*").alias("num_views"))
    return w.select(F.col("w.start").alias("tstamp"), "page_id", "num_views")


def run_available(counts: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Appends what is complete to Parquet, for all input there is now; a second call goes on where the first ended."""
    return counts.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
