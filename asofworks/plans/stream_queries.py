"""Queries that run as streams over files and give the rows of their batch forms, so that the same SQL holds for both."""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from asofworks.operators.storage import shared_folder
from asofworks.streaming import events as S
from asofworks.streaming.lifecycle import lifecycle_stream

from . import derived as D
from .derived import sql, table
from .text_queries import ORACLES as TEXT_ORACLES

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(oracle: str):
    def add(f):
        QUERIES[f.__name__] = f
        ORACLES[f.__name__] = oracle
        return f

    return add


def arriving(df: DataFrame, folder: str, time: str, waves: int = 4) -> DataFrame:
    """df as a stream of files: waves by time, the rows of each in two files and in an order of their own; then what ends the last."""
    spark = df.sparkSession
    first, last = df.agg(F.min(F.unix_timestamp(time)), F.max(F.unix_timestamp(time))).first()
    wave = F.floor((F.unix_timestamp(time) - first) * waves / ((last - first) + 1))
    for k in range(waves):
        df.where(wave == k).repartition(2, F.xxhash64(*df.columns)).sortWithinPartitions(F.xxhash64(*df.columns)).write.mode("append").parquet(folder)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 2).parquet(folder)


def run(stream: DataFrame, folder: str) -> DataFrame:
    """The rows of a stream, run until all files are read."""
    writer = stream.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state")
    writer.trigger(availableNow=True).start().awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{folder}/out")


@query(sql("SELECT * FROM panel", "panel"))
def lifecycle_streamed(spark: SparkSession, d: str) -> DataFrame:
    """lifecycle_panel by a stream: items in shuffled micro-batches, exits by timers."""
    folder = f"{shared_folder(spark)}/stream-{uuid4().hex}"
    items, months = D.items(spark, d), D.months(spark, d)
    # a row behind the last month, of no item of the panel, lets the watermark pass that month, and no other one
    beat = months.agg(F.date_add(F.max("as_of"), 1 + LATE_DAYS).alias("as_of")).select("as_of", *[(F.lit("") if c == "item" else F.lit(0) if c in ("stance_sign", "conviction") else F.lit(None)).cast(items.schema[c].dataType).alias(c) for c in items.columns if c != "as_of"])
    stream = arriving(items, f"{folder}/in", "as_of")
    for _ in range(3):  # the last one is read when the watermark of those before holds
        beat.coalesce(1).write.mode("append").parquet(f"{folder}/in")
    return run(lifecycle_stream(stream, f"{LATE_DAYS} days"), folder).where("item <> ''")


#: Waves of the streams above overlap by no more than this.
LATE_DAYS = 1_200


def turns(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Turns as posts that quote the user's turn two before every third one, and users' texts; a minute a turn, an hour a conversation."""
    c = table(spark, d, "conversations")
    at = lambda turn: F.timestamp_seconds(F.lit(1_700_000_000) + F.col("conv_id") * 3600 + turn * 60)
    key = lambda turn: F.format_string("%d-%d", "conv_id", turn)
    posts = c.select("conv_id", "turn", at(F.col("turn")).alias("ts"), F.when(F.col("turn") % 3 == 2, key(F.col("turn") - 2)).alias("quoted_id"))
    return posts, c.where("role = 'user'").select(key(F.col("turn")).alias("id"), at(F.col("turn")).alias("ts"), "text")


@query(TEXT_ORACLES["quoted_context"])
def quoted_streamed(spark: SparkSession, d: str) -> DataFrame:
    """quoted_context by a join of two streams."""
    folder = f"{shared_folder(spark)}/stream-{uuid4().hex}"
    posts, texts = turns(spark, d)
    end = posts.agg((F.max("ts") + F.expr("INTERVAL 400 days")).alias("ts"))
    sides = []
    for name, df in (("posts", posts), ("texts", texts)):
        stream = arriving(df, f"{folder}/{name}", "ts")
        for _ in range(3):  # rows far behind end the wait of all others
            end.select(*[(F.col("ts") if c == "ts" else F.lit("") if c.endswith("id") and c != "conv_id" else F.lit(None)).cast(df.schema[c].dataType).alias(c) for c in df.columns]).coalesce(1).write.mode("append").parquet(f"{folder}/{name}")
        sides.append(stream)
    out = run(S.quoted_stream(*sides, late="365 days", within="1 days"), folder).where("conv_id IS NOT NULL")
    return out.select("conv_id", "turn", F.md5("context").alias("context"), "context_missing")
