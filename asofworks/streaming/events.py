"""Event-time aggregates that run alike on a table and on a stream (with a watermark)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from asofworks.sources.files import exists


def tumbling(events: DataFrame, width: str = "1 hour", late: str = "10 minutes", ts: str = "ts") -> DataFrame:
    """Per window and type: number and sum of values; rows later than the watermark are left out on a stream."""
    own = events.withWatermark(ts, late).groupBy(F.window(ts, width), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return own.select(F.col("window.start").alias("window_start"), "event_type", "n", "total")


def sliding(events: DataFrame, width: str = "2 hours", step: str = "1 hour", late: str = "10 minutes", ts: str = "ts") -> DataFrame:
    own = events.withWatermark(ts, late).groupBy(F.window(ts, width, step)).agg(F.count("*").alias("n"))
    return own.select(F.col("window.start").alias("window_start"), "n")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "10 minutes", ts: str = "ts", key: str = "user_id") -> DataFrame:
    """A user's events with gaps under `gap`: begin, end of the last event's gap, number."""
    own = events.withWatermark(ts, late).groupBy(F.session_window(ts, gap), key).agg(F.count("*").alias("n"))
    return own.select(key, F.col("session_window.start").alias("session_start"), F.col("session_window.end").alias("session_end"), "n")


def quoted_stream(posts: DataFrame, texts: DataFrame, late: str = "1 hour", within: str = "30 days") -> DataFrame:
    """posts (ts, quoted_id, ...) with the text that they quote as context, and context_missing where it does not come, of streams.

    texts: (id, ts, text). A post waits for a text that is no older than `within`
    and no younger than itself until the watermark tells that none can come any
    more; so both sides' state ends `within` and `late` behind the newest rows.
    """
    own = posts.withWatermark("ts", late)
    said = texts.select(F.col("id").alias("_id"), F.col("ts").alias("_ts"), F.col("text").alias("context")).withWatermark("_ts", late)
    meet = (F.col("quoted_id") == F.col("_id")) & (F.col("_ts") <= F.col("ts")) & (F.col("_ts") >= F.col("ts") - F.expr(f"INTERVAL {within}"))
    both = own.join(said, meet, "left_outer")
    return both.withColumn("context_missing", F.col("quoted_id").isNotNull() & F.col("_id").isNull()).drop("_id", "_ts")


def append_new(batch: DataFrame, path: str, key: str) -> None:
    """For foreachBatch and resumable jobs: appends the rows whose key the table at path lacks.

    Only the keys of the table are read, and of those only the batch's own.
    """
    own = batch.dropDuplicates([key])
    if exists(batch.sparkSession, path):
        done = batch.sparkSession.read.schema(batch.schema).parquet(path).select(key)
        own = own.join(done, key, "left_anti")
    own.write.mode("append").parquet(path)
