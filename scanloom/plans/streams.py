"""Queries over streams: the events table read in chunks, with what is there processed and then stopped.

Each run has a folder of its own below the shared one, for the checkpoint and the result.
"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from scanloom.sources.shared import fresh_folder
from scanloom.streaming import streams

from .registry import register, table


def _events(spark: SparkSession, d: str) -> DataFrame:
    return streams.parquet_chunks(spark, f"{d}/events.parquet*", table(spark, d, "events").schema)


def _folder(spark: SparkSession) -> str:
    return fresh_folder(spark, "stream")


def _logged(stream: DataFrame, mode: str) -> DataFrame:
    """All batches' rows with their batch's number."""
    spark, folder = stream.sparkSession, _folder(stream.sparkSession)
    streams.run_available(stream, streams.append_log(f"{folder}/log"), f"{folder}/checkpoint", mode)
    schema = StructType([*stream.schema.fields, StructField("batch", LongType())])  # the batch is a partition column
    return spark.read.schema(schema).parquet(f"{folder}/log")


@register("t2_chunks", "SELECT event_id, user_id, event_type, value FROM events")
def chunks(spark, d):
    return _logged(_events(spark, d).select("event_id", "user_id", "event_type", "value"), "append").drop("batch")


@register("t3_shuffled", "SELECT event_id, value FROM events")
def shuffled(spark, d):
    return streams.shuffled(table(spark, d, "events").select("event_id", "value"), "event_id", 0, 1)


@register(
    "t6_running_average",
    "SELECT event_type, round(sum(value * (1 + event_id % 3)) / sum(1 + event_id % 3), 4) AS average, CAST(sum(1 + event_id % 3) AS BIGINT) AS weight FROM events WHERE value IS NOT NULL AND isfinite(value) GROUP BY 1",
)
def running_average(spark, d):
    weighted = _events(spark, d).select("event_type", "value", (1 + F.col("event_id") % 3).alias("w"))
    log = _logged(streams.running_average(weighted, ["event_type"], "value", "w"), "update")
    last = log.groupBy("event_type").agg(F.max_by(F.struct("average", "weight"), "batch").alias("last"))
    return last.select("event_type", F.round("last.average", 4).alias("average"), "last.weight")


@register("t7_metric_log", "SELECT event_type, count(*) AS n, round(min(value), 4) AS low, round(max(value), 4) AS high FROM events GROUP BY 1")
def metric_log(spark, d):
    stats = _events(spark, d).groupBy("event_type").agg(F.count("*").alias("n"), F.min("value").alias("low"), F.max("value").alias("high"))
    last = _logged(stats, "update").groupBy("event_type").agg(F.max_by(F.struct("n", "low", "high"), "batch").alias("last"))
    return last.select("event_type", "last.n", F.round("last.low", 4).alias("low"), F.round("last.high", 4).alias("high"))


@register("t10_windowed_counts", "SELECT strftime(ts, '%Y-%m-%d %H') AS hour, event_type, count(*) AS n FROM events WHERE ts IS NOT NULL GROUP BY 1, 2")
def windowed_counts(spark, d):
    # the files of a table aren't in the order of time, so no row counts as late
    counts = streams.windowed_counts(_events(spark, d), "ts", "event_type", "1 hour", "36500 days")
    last = _logged(counts, "update").groupBy("start", "event_type").agg(F.max_by("n", "batch").alias("n"))
    return last.select(F.date_format("start", "yyyy-MM-dd HH").alias("hour"), "event_type", "n")
