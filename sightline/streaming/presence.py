"""Brand presence and gallery growth on streams: an extension beside the batch operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..sources.writers import append_new


def sessions(events: DataFrame, gap: str = "10 minutes", late: str = "30 minutes") -> DataFrame:
    """Sessions of each brand of a video: start, stop, n and the highest score.

    events(video, brand, ts, score), a stream or a table.  Rows later than
    `late` are dropped from a stream; a session ends after `gap` without rows.
    """
    rows = events.where(F.coalesce("brand", F.lit("UNKNOWN")) != "UNKNOWN").withColumn("ts", F.col("ts").cast("timestamp"))
    if rows.isStreaming:
        rows = rows.withWatermark("ts", late)
    s = rows.groupBy("video", "brand", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n"), F.max("score").alias("score"))
    return s.select("video", "brand", F.col("w.start").alias("start"), F.col("w.end").alias("stop"), "n", "score")


def counts(events: DataFrame, window: str = "1 hour", late: str = "30 minutes") -> DataFrame:
    """Detections of each brand in windows of fixed length."""
    rows = events.withColumn("ts", F.col("ts").cast("timestamp"))
    if rows.isStreaming:
        rows = rows.withWatermark("ts", late)
    c = rows.groupBy(F.window("ts", window).alias("w"), "brand").agg(F.count("*").alias("n"))
    return c.select(F.col("w.start").alias("start"), "brand", "n")


def grow_gallery(vectors: DataFrame, path: str, checkpoint: str, key: list[str]) -> StreamingQuery:
    """Append a stream of vectors to a gallery, each key once even if a batch is run again."""
    return vectors.writeStream.foreachBatch(lambda batch, turn: append_new(batch, path, key, f"{checkpoint}#{turn}")).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
