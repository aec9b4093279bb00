"""Structured Streaming forms of the incremental operators."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from scanloom.operators.joins import numbered


def csv_chunks(spark: SparkSession, folder: str, schema: str, files_per_trigger: int = 1) -> DataFrame:
    """CSV files as a stream of bounded chunks."""
    return spark.readStream.option("header", "true").option("maxFilesPerTrigger", str(files_per_trigger)).schema(schema).csv(folder)


def parquet_chunks(spark: SparkSession, folder: str, schema: str | StructType, files_per_trigger: int = 1) -> DataFrame:
    return spark.readStream.option("maxFilesPerTrigger", str(files_per_trigger)).schema(schema).parquet(folder)


def run_available(stream: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "append") -> StreamingQuery:
    """Process what is there in micro-batches and stop; a restart goes on where it ended."""
    query = stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(sink).start()
    query.awaitTermination()
    return query


def running_average(stream: DataFrame, group: Sequence[str], value: str, weight: str) -> DataFrame:
    """Weighted average so far of each group, without values that aren't finite."""
    v = F.col(value)
    ok = v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf"))
    return stream.where(ok).groupBy(*group).agg((F.sum(v * F.col(weight)) / F.sum(weight)).alias("average"), F.sum(weight).alias("weight"))


def windowed_counts(stream: DataFrame, ts: str, key: str, width: str, late: str) -> DataFrame:
    """Counts by event-time window and key; rows later than ``late`` are dropped."""
    timed = stream.withColumn(ts, F.col(ts).cast("timestamp"))  # event time has a zone
    return timed.withWatermark(ts, late).groupBy(F.window(ts, width).alias("w"), key).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), key, "n")


def closed_windows(stream: DataFrame, ts: str, key: str, width: str, late: str) -> DataFrame:
    """Counts of windows that the watermark has passed; for append mode. A row whose window is closed when it comes is left out."""
    return windowed_counts(stream, ts, key, width, late)


def closed_sessions(stream: DataFrame, ts: str, key: str, gap: str, late: str) -> DataFrame:
    """(start, end, key, n) of sessions, runs of rows of a key less than ``gap`` apart, once the watermark has passed them; for append mode."""
    timed = stream.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late)
    return timed.groupBy(F.session_window(ts, gap).alias("w"), key).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), key, "n")


def replayed(chunks: DataFrame, number: str, folder: str, query: Callable[[DataFrame], DataFrame], sink: Callable[[DataFrame, int], None]) -> int:
    """Feed the rows of chunk after chunk to a stream, each as a restart from the checkpoint; returns the rows (or partial sums) dropped as late.

    The chunks' files stay, so a restart after a failure goes on where the last one ended.
    """
    spark, dropped = chunks.sparkSession, 0
    numbers = [r[0] for r in chunks.select(number).distinct().orderBy(number).collect()]
    schema = chunks.drop(number).schema
    for n in numbers:
        chunks.where(F.col(number) == n).drop(number).write.mode("append").parquet(f"{folder}/in")
        source = spark.readStream.schema(schema).parquet(f"{folder}/in")
        ran = run_available(query(source), sink, f"{folder}/checkpoint")
        dropped += sum(o.numRowsDroppedByWatermark for p in ran.recentProgress for o in p.stateOperators)
    return dropped


def append_log(folder: str) -> Callable[[DataFrame, int], None]:
    """A sink that appends each batch once: a repeated batch replaces its own part."""

    def sink(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{folder}/batch={number}")

    return sink


def sharded(df: DataFrame, order: str, worker: int, workers: int) -> DataFrame:
    """The rows that a worker gets when rows are dealt out in turn, in the order of a column."""
    return numbered(df, [order]).where(F.pmod("__row", F.lit(workers)) == worker).drop("__row")


def epoch_places(df: DataFrame, key: str, seed: int, epoch: int, size: int) -> DataFrame:
    """Adds ``place``: the row's place in an epoch through a shuffle buffer of ``size`` rows.

    Rows come in the order of the key; each is held back by fewer than ``size`` rows, which a hash draws.
    """
    held = F.pmod(F.xxhash64(F.lit(seed + epoch), F.col(key)), F.lit(size))
    order = numbered(df, [key], "__in").withColumn("__due", F.col("__in") + held)
    return numbered(order, ["__due", "__in"], "place").drop("__in", "__due")


def shuffled(df: DataFrame, key: str, seed: int, epoch: int) -> DataFrame:
    """Rows in an order that the seed and the epoch decide, and partitions don't."""
    return df.orderBy(F.xxhash64(F.lit(seed + epoch), F.col(key)), key)
