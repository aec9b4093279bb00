"""Helpers that the training-data operators share."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession

#: Rows and bytes of one Arrow batch: a Python worker holds a few of these at once.
BATCH_ROWS, BATCH_BYTES = 2000, 16 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession) -> None:
    """Bound the Arrow batches by rows and bytes, as texts can be very long."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: ``spark.checkpoint.dir`` where the session has it.

    Only where executors are this machine's own threads may it be a folder of this machine.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = f"file://{tempfile.mkdtemp(prefix='scanloom-')}"
        spark.conf.set("spark.checkpoint.dir", base)
    return base


def _written(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/scanloom/{spark.sparkContext.applicationId}"


def forget(spark: SparkSession) -> None:
    """Remove what ``cut`` has written for this application; for when none of its results are read any more."""
    path = spark._jvm.org.apache.hadoop.fs.Path(_written(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    Later steps then restart from the files and not from the source when an
    executor is lost, and what is used twice is computed once.
    """
    spark = df.sparkSession
    path = f"{_written(spark)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def ragged_take(flat: np.ndarray, off: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Concatenate the slices ``flat[off[c]:off[c + 1]]`` of each code; also their offsets."""
    lens = off[codes + 1] - off[codes]
    out = np.zeros(len(codes) + 1, np.int64)
    np.cumsum(lens, out=out[1:])
    at = np.arange(out[-1]) + np.repeat(off[codes] - out[:-1], lens)
    return flat[at], out


def offsets(lens) -> np.ndarray:
    out = np.zeros(len(lens) + 1, np.int64)
    np.cumsum(np.asarray(lens, np.int64), out=out[1:])
    return out


def text_chunks(texts: list, limit: int = 4 << 20):
    """Index ranges of ``texts`` that hold about ``limit`` characters each."""
    start, size = 0, 0
    for i, t in enumerate(texts):
        size += len(t) if t is not None else 0
        if size >= limit:
            yield start, i + 1
            start, size = i + 1, 0
    if start < len(texts):
        yield start, len(texts)
