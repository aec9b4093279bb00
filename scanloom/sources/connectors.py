"""Spark data sources of the library's own: volume headers, and tables that are replaced as a whole.

``volume_headers`` plans partitions of files and reads the first bytes of each, never its
voxels. ``whole_csv`` writes parts aside and moves them into place when all tasks have
succeeded, with what was there before as a backup; after a failure the old table stays as
it was. Both work on folders that every executor mounts; another kind of path is an error.

Defined results: a file that isn't a volume has its error in the row; a folder without
files gives no rows; null is blank in the table, text is quoted where it must be; a
repeated task's parts replace none of another's, as only committed parts are moved.
"""

from __future__ import annotations

import csv
import fnmatch
import gzip
import os
import shutil
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark import TaskContext
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

from .volumes import HEADER, HEADER_BYTES, affine_hash, nifti_header


def mounted(path: str) -> str:
    """The path in a folder that is mounted here."""
    scheme, colon, rest = path.partition(":")
    if not colon:
        return path
    if scheme != "file":
        raise ValueError(f"{path} isn't in a mounted folder")
    return "/" + rest.lstrip("/")


# -- headers ---------------------------------------------------------------------


class Files(InputPartition):
    def __init__(self, paths: list[str]):
        self.paths = paths


class HeaderReader(DataSourceReader):
    def __init__(self, options: dict):
        self.root, self.glob = mounted(options["path"]), options.get("glob", "*.nii*")
        self.per_task = int(options.get("filespertask", 1000))

    def partitions(self) -> list[InputPartition]:
        found = sorted(os.path.join(d, f) for d, _, names in os.walk(self.root) for f in names if fnmatch.fnmatch(f, self.glob))
        return [Files(found[i : i + self.per_task]) for i in range(0, len(found), self.per_task)] or [Files([])]

    def read(self, partition: Files) -> Iterator[tuple]:
        for path in partition.paths:
            try:
                with (gzip.open if path.endswith(".gz") else open)(path, "rb") as f:
                    shape, spacing, dtype, affine = nifti_header(f.read(HEADER_BYTES))
                yield path, [int(n) for n in shape], [float(x) for x in spacing], dtype, affine.ravel().tolist(), affine_hash(affine), None
            except Exception as e:  # a broken file is a finding, not a failure
                yield path, None, None, None, None, None, f"{type(e).__name__}: {e}"


class VolumeHeaders(DataSource):
    @classmethod
    def name(cls) -> str:
        return "volume_headers"

    def schema(self) -> str:
        return HEADER

    def reader(self, schema: StructType) -> DataSourceReader:
        return HeaderReader(self.options)


def volume_headers(spark: SparkSession, folder: str, glob: str = "*.nii*", files_per_task: int = 1000) -> DataFrame:
    """(path, shape, spacing, dtype, affine, affine_hash, error) of the files below a folder."""
    spark.dataSource.register(VolumeHeaders)
    return spark.read.format("volume_headers").option("glob", glob).option("filesPerTask", str(files_per_task)).load(folder)


# -- tables that are replaced as a whole -----------------------------------------


@dataclass
class Part(WriterCommitMessage):
    path: str


class WholeWriter(DataSourceWriter):
    def __init__(self, options: dict, columns: list[str]):
        self.target, self.columns = mounted(options["path"]).rstrip("/"), columns
        self.backup, self.staging = options.get("backup", ".bak"), f"{self.target}.{uuid.uuid4().hex}.new"

    def write(self, rows: Iterator[Row]) -> Part:
        task = TaskContext.get()
        os.makedirs(self.staging, exist_ok=True)
        path = os.path.join(self.staging, f"part-{task.partitionId():05d}-{task.taskAttemptId()}.csv")
        with open(path, "w", newline="", encoding="utf-8") as f:
            out = csv.writer(f, lineterminator="\n", doublequote=False, escapechar="\\")  # as Spark reads it
            out.writerow(self.columns)
            for r in rows:
                out.writerow(["" if v is None else str(v).lower() if isinstance(v, bool) else v for v in r])
        return Part(path)

    def commit(self, messages: list[Part | None]) -> None:
        os.makedirs(self.staging, exist_ok=True)
        whole = {os.path.basename(m.path) for m in messages if m is not None}
        for f in os.listdir(self.staging):
            if f not in whole:  # of an attempt that was given up
                os.unlink(os.path.join(self.staging, f))
        if os.path.lexists(self.target):
            old = self.target + self.backup
            shutil.rmtree(old, ignore_errors=True)
            os.replace(self.target, old)
        os.replace(self.staging, self.target)

    def abort(self, messages: list[Part | None]) -> None:
        shutil.rmtree(self.staging, ignore_errors=True)


class WholeCsv(DataSource):
    @classmethod
    def name(cls) -> str:
        return "whole_csv"

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        return WholeWriter(self.options, schema.names)


def write_whole(df: DataFrame, folder: str, backup: str = ".bak") -> None:
    """Replace the table in ``folder``; what was there is the folder's name with ``backup``."""
    df.sparkSession.dataSource.register(WholeCsv)
    df.write.format("whole_csv").mode("append").option("backup", backup).save(folder)


def rewrite_column(spark: SparkSession, folder: str, schema: str, key: str, column: str, values: DataFrame) -> DataFrame:
    """Set a column of a CSV table to the values of (key, column) where there are some, the old table kept as a backup; returns the new one."""
    old = spark.read.schema(schema).option("header", "true").csv(folder)
    new = values.groupBy(key).agg(F.min(column).alias("__new"))
    both = old.join(new, key, "left").withColumn(column, F.coalesce("__new", column)).select(*old.columns)
    write_whole(both, folder)
    return spark.read.schema(schema).option("header", "true").csv(folder)
