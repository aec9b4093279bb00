"""The folder that the driver and all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session; a folder of this machine only where executors are its own threads."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = f"file://{tempfile.mkdtemp(prefix='scanloom-')}"
        spark.conf.set("spark.checkpoint.dir", base)
    return base


def _own(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/scanloom/{spark.sparkContext.applicationId}"


def fresh_folder(spark: SparkSession, what: str) -> str:
    """A path of this application below it that nothing else uses."""
    return f"{_own(spark)}/{what}-{uuid.uuid4().hex}"


def forget(spark: SparkSession) -> None:
    """Remove all that this application has written there; for when no result that reads it is used any more."""
    path = spark._jvm.org.apache.hadoop.fs.Path(_own(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def written(df: DataFrame) -> DataFrame:
    """The rows, from files in the shared folder: computed once, and there again when an executor is lost."""
    path = fresh_folder(df.sparkSession, "written")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
