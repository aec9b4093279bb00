"""Files below a folder, listed and read by tasks where the folder is mounted.

Folders are dealt out level by level, and a task lists its own without opening a file;
a path's files are then dealt out by number, not a few to a task. So many small files
neither pass through the driver nor make a task each. Other stores are listed by Spark.

Defined results: empty files, names that begin with a dot or an underscore, and files that
are being copied are left out, as Spark leaves them; a path that isn't there has no files.
"""

from __future__ import annotations

import fnmatch
import os
from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import written

LISTED = "path string, size long, modified timestamp"
#: Rows and bytes that a task hands on at a time.
ROWS, BYTES = 10_000, 1 << 25


def shares(spark: SparkSession) -> int:
    """So many tasks that every core gets some of them; each has its share of the files."""
    return 4 * spark.sparkContext.defaultParallelism


def local_path(spark: SparkSession, path: str) -> str | None:
    """The path in a mounted folder, or None where it is in another store or is a pattern."""
    scheme, colon, rest = path.partition(":")
    if any(c in path for c in "*?[{"):
        return None
    if not colon or "/" in scheme:
        return path if path.startswith("/") and spark._jsc.hadoopConfiguration().get("fs.defaultFS", "file:///").startswith("file:") else None
    return "/" + rest.lstrip("/") if scheme == "file" else None


def _hidden(name: str) -> bool:
    return name.startswith(".") or (name.startswith("_") and "=" not in name) or name.endswith("._COPYING_")


def _scan(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The entries of folders; a path that is a file is its own entry."""

    def entries(folder: str) -> Iterator[tuple]:
        if not os.path.isdir(folder):
            if os.path.isfile(folder):
                s = os.stat(folder)
                yield folder, False, s.st_size, int(s.st_mtime * 1000)
            return
        with os.scandir(folder) as found:
            for e in found:
                if _hidden(e.name):
                    continue
                if e.is_dir():
                    yield e.path, True, 0, 0
                elif e.is_file():
                    s = e.stat()
                    yield e.path, False, s.st_size, int(s.st_mtime * 1000)

    columns, rows = ["path", "is_folder", "size", "modified"], []
    for pdf in parts:
        for folder in pdf["path"]:
            for e in entries(folder):
                rows.append(e)
                if len(rows) == ROWS:
                    yield pd.DataFrame(rows, columns=columns)
                    rows = []
    if rows:
        yield pd.DataFrame(rows, columns=columns)


def files_below(spark: SparkSession, root: str, glob: str = "*", deep: bool = True) -> DataFrame:
    """(path, size, modified) of the files whose names match; without ``deep`` those of the folder itself."""
    own = local_path(spark, root)
    if own is None or "{" in glob:
        read = spark.read.format("binaryFile").option("recursiveFileLookup", str(deep).lower()).option("pathGlobFilter", glob)
        try:
            return read.load(root).select("path", F.col("length").alias("size"), F.col("modificationTime").alias("modified"))
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return spark.createDataFrame([], LISTED)
    level, levels = spark.createDataFrame([(own.rstrip("/") or "/",)], "path string"), []
    while True:
        found = written(level.repartition(shares(spark), "path").mapInPandas(_scan, "path string, is_folder boolean, size long, modified long"))
        levels.append(found.where("NOT is_folder AND size > 0"))
        level = found.where("is_folder").select("path")
        if not deep or level.isEmpty():
            break

    @F.arrow_udf("boolean")
    def matches(paths):
        import pyarrow as pa

        return pa.array([fnmatch.fnmatchcase(os.path.basename(p), glob) for p in paths.to_pylist()], pa.bool_())

    files = reduce(DataFrame.union, levels)
    files = files if glob == "*" else files.where(matches("path"))
    return files.select(F.concat(F.lit("file:"), "path").alias("path"), "size", F.timestamp_millis("modified").alias("modified"))


def contents(spark: SparkSession, root: str, glob: str = "*", deep: bool = True) -> DataFrame:
    """(path, content) of the files below a folder."""
    if local_path(spark, root) is None or "{" in glob:
        read = spark.read.format("binaryFile").option("recursiveFileLookup", str(deep).lower()).option("pathGlobFilter", glob)
        return read.load(root).select("path", "content")

    def read_files(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        paths, held, size = [], [], 0
        for pdf in parts:
            for path in pdf["path"]:
                with open(path.removeprefix("file:"), "rb") as f:
                    held.append(f.read())
                paths.append(path)
                size += len(held[-1])
                if size > BYTES or len(held) == ROWS:
                    yield pd.DataFrame({"path": paths, "content": held})
                    paths, held, size = [], [], 0
        if paths:
            yield pd.DataFrame({"path": paths, "content": held})

    return files_below(spark, root, glob, deep).select("path").repartition(shares(spark), "path").mapInPandas(read_files, "path string, content binary")
