"""Tabular, nested and file-listing sources with their contracts, and sinks."""

from __future__ import annotations

import gzip
import json
import zlib
from collections.abc import Mapping, Sequence
from pathlib import PurePosixPath

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scanloom.functions.scalars import dirname, stem
from scanloom.operators.joins import fold_join
from scanloom.operators.metrics import describe
from scanloom.operators.sets import require_columns

from . import mounts


def _readable(make, empty):
    try:
        return make()
    except AnalysisException as e:
        if e.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return empty()
        raise


def csv_typed(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """CSV with a given schema; NaN and blank are null; a path that isn't there is an empty table."""
    read = spark.read.option("header", "true").option("nanValue", "NaN").option("mode", "PERMISSIVE").schema(schema)
    out = _readable(lambda: read.csv(path), lambda: spark.createDataFrame([], schema))
    return out.select(*(F.nanvl(F.col(c), F.lit(None)).alias(c) if t in ("float", "double") else F.col(c) for c, t in out.dtypes))


def csv_text(spark: SparkSession, path: str) -> DataFrame:
    """CSV with every column a string; a byte-order mark is taken off the first name."""
    empty = T.StructType([])
    out = _readable(lambda: spark.read.option("header", "true").option("inferSchema", "false").csv(path), lambda: spark.createDataFrame([], empty))
    return out.toDF(*(c.lstrip("﻿") for c in out.columns)) if out.columns else out


def mapping_csv(spark: SparkSession, path: str, required: Sequence[str]) -> DataFrame:
    return require_columns(csv_text(spark, path), required)


def csv_joined(spark: SparkSession, paths: Sequence[str], on: Sequence[str] | None = None, how: str = "inner", columns: Sequence[str] | None = None, types: Mapping[str, str] | None = None) -> DataFrame:
    """Several CSVs joined from left to right, projected and cast."""
    out = fold_join([csv_text(spark, p) for p in paths], on, how)
    if columns:
        out = out.select(*columns)
    return out.withColumns({c: F.col(c).cast(t) for c, t in (types or {}).items()})


def json_object(spark: SparkSession, path: str, schema: str, deep: bool = False) -> DataFrame:
    """Whole-file JSON objects; invalid files and other values give no row. With ``deep`` those of subfolders too."""

    def text(paths: pa.Array, contents: pa.Array) -> pa.Array:
        texts: list[str | None] = []
        for name, data in zip(paths.to_pylist(), contents.to_pylist(), strict=True):
            try:
                data = gzip.decompress(data) if name.endswith(".gz") else data
                texts.append(data.decode(json.detect_encoding(data)))
            except (OSError, EOFError, UnicodeDecodeError, zlib.error):
                texts.append(None)
        return pa.array(texts, pa.string())

    files = _readable(lambda: mounts.contents(spark, path, deep=deep), lambda: spark.createDataFrame([], "path string, content binary"))
    texts = files.select(F.arrow_udf(text, "string")("path", "content").alias("value")).where(F.trim(F.regexp_replace("value", r"^\s+", "")).startswith("{"))
    whole = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "__bad", "allowNonNumericNumbers": "true"}
    return texts.select(F.from_json("value", f"{schema}, __bad string", whole).alias("r")).where("r IS NOT NULL AND r.__bad IS NULL").select("r.*").drop("__bad")


def json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON Lines without blank lines, broken lines and values that aren't objects."""
    lines = _readable(lambda: spark.read.text(path), lambda: spark.createDataFrame([], "value string"))
    parsed = lines.where(F.trim("value").startswith("{")).select(F.from_json("value", schema, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}).alias("r"), F.try_parse_json("value").alias("v"))
    return parsed.where("v is not null").select("r.*")


def whole_texts(spark: SparkSession, path: str) -> DataFrame:
    """(path, value) of whole text files, such as metric documents."""
    return spark.read.option("wholetext", "true").text(path).select(F.input_file_name().alias("path"), "value")


SPLIT = "struct<train:array<string>,val:array<string>,test:array<string>>"


def split_documents(texts: DataFrame, value: str = "value") -> DataFrame:
    """(fold, split, id) of split documents; a single object is a list of one."""
    doc = F.trim(value)
    folds = F.from_json(F.when(doc.startswith("{"), F.concat(F.lit("["), doc, F.lit("]"))).otherwise(doc), f"array<{SPLIT}>")
    rows = texts.select(F.posexplode(folds).alias("fold", "s"))
    parts = F.explode(F.create_map(*(x for k in ("train", "val", "test") for x in (F.lit(k), F.col(f"s.{k}")))))
    return rows.select("fold", parts.alias("split", "ids")).select("fold", "split", F.explode("ids").alias("id"))


def datalist(texts: DataFrame, section: str, base: str | None = None, keys: Sequence[str] = ("image", "label"), value: str = "value") -> DataFrame:
    """Records of a section of a datalist document, paths prefixed by ``base``; ``fold`` null where it is missing."""
    shape = "array<struct<" + ",".join(f"{k}:string" for k in keys) + ",fold:int>>"
    records = texts.select(F.explode(F.from_json(F.get_json_object(value, f"$.{section}"), shape)).alias("r")).select("r.*")
    if base:
        records = records.withColumns({k: F.concat(F.lit(base.rstrip("/") + "/"), k) for k in keys})
    return records


def fold_parts(records: DataFrame, fold: int) -> tuple[DataFrame, DataFrame]:
    """(training, validation); a record without a fold is for training."""
    held = F.coalesce(F.col("fold") == fold, F.lit(False))
    return records.where(~held), records.where(held)


def yaml_records(spark: SparkSession, text: str, schema: str) -> DataFrame:
    """A small YAML mapping of named records, read on the driver, with an explicit schema."""
    import yaml

    doc = yaml.safe_load(text) or {}
    if not isinstance(doc, dict) or not all(isinstance(v, dict) for v in doc.values()):
        raise ValueError("expected a mapping of names to records")
    known = T.StructType.fromDDL(schema).names
    if odd := sorted({f for v in doc.values() for f in v} - set(known)):
        raise ValueError(f"fields that the schema doesn't have: {', '.join(odd)}")
    return spark.createDataFrame([(k, *(v.get(f) for f in known)) for k, v in doc.items()], f"name string, {schema}")


def overlaid(base: DataFrame, settings: DataFrame, key: str) -> DataFrame:
    """Settings with their nulls filled from the record of ``base`` that they name; a setting that isn't null wins."""
    shared = [c for c in base.columns if c != key and c in settings.columns]
    own = base.groupBy(key).agg(*(F.first(c).alias(f"__{c}") for c in shared))
    out = settings.join(own, key, "left").withColumns({c: F.coalesce(c, f"__{c}") for c in shared})
    return out.drop(*(f"__{c}" for c in shared))


def listing(spark: SparkSession, root: str, glob: str = "*") -> DataFrame:
    """(path, size, modified) of files below a folder, without their contents."""
    return mounts.files_below(spark, root, glob)


def parent_folders(files: DataFrame, suffixes: Sequence[str]) -> DataFrame:
    """Distinct folders that hold a file with one of the suffixes."""
    keep = F.lit(False)
    for s in suffixes:
        keep = keep | F.col("path").endswith(s)
    return files.where(keep).select(dirname("path").alias("folder")).distinct().orderBy("folder")


def modality_files(files: DataFrame, modalities: Sequence[str]) -> DataFrame:
    """One row per case folder with the first file of each modality, or null."""
    own = files.select(dirname("path").alias("folder"), "path", F.lower(stem("path")).alias("name"))
    picks = [F.min(F.when(F.col("name").endswith(m), F.col("path"))).alias(m) for m in modalities]
    return own.groupBy("folder").agg(*picks)


def completeness(table: DataFrame, modalities: Sequence[str]) -> DataFrame:
    """Adds ``missing`` and whether a case is complete."""
    lost = F.array_compact(F.array(*(F.when(F.col(m).isNull(), F.lit(m)) for m in modalities)))
    return table.withColumn("missing", F.concat_ws(",", lost)).withColumn("complete", F.col("missing") == "")


def missing_files(records: DataFrame, keys: Sequence[str], files: DataFrame) -> DataFrame:
    """Referenced paths that the listing lacks."""
    asked = records.select(F.explode(F.array(*keys)).alias("path")).where("path is not null").distinct()
    return asked.join(files.select("path"), "path", "left_anti")


def checksums(spark: SparkSession, root: str, expected: DataFrame) -> DataFrame:
    """Listed files (name, md5) whose content differs or is absent."""
    got = mounts.contents(spark, root).select(F.element_at(F.split("path", "/"), -1).alias("name"), F.md5("content").alias("found"))
    return expected.join(got, "name", "left").where(F.col("found").isNull() | (F.col("found") != F.col("md5")))


# -- sinks -----------------------------------------------------------------------


def write_csv(df: DataFrame, path: str, first: Sequence[str] = (), mode: str = "error") -> None:
    """CSV parts with the given columns first and the others sorted; null is blank."""
    order = [*first, *sorted(c for c in df.columns if c not in first)]
    df.select(*order).write.mode(mode).option("header", "true").option("lineSep", "\n").option("emptyValue", "").csv(path)


def write_json(df: DataFrame, path: str, mode: str = "error") -> None:
    df.write.mode(mode).option("ignoreNullFields", "false").json(path)


def write_report(raw: DataFrame, folder: str, metric: str) -> None:
    """A metric's report from (case, class, value): ``{metric}_raw`` with a row per case and class, ``{metric}_summary``
    with a row per class and one, 'mean', of the cases' means over their classes, and ``{metric}_overall`` with the mean of these.
    """
    means = raw.groupBy("case").agg(F.avg(F.nanvl("value", F.lit(None))).alias("value")).withColumn("class", F.lit("mean"))
    rows = raw.select("case", "class", "value").unionByName(means)
    write_csv(rows, f"{folder}/{metric}_raw", ["case", "class"])
    summary = describe(rows, ["class"], "value", (90,)).select("class", "mean", "median", "max", "min", F.col("p90"), "std", "notnans")
    summary.write.option("header", "true").csv(f"{folder}/{metric}_summary")
    write_csv(means.agg(F.avg("value").alias(metric)), f"{folder}/{metric}_overall")


def markdown(df: DataFrame, limit: int) -> str:
    """A small table as Markdown; at most ``limit`` rows come to the driver."""
    rows = df.limit(limit).collect()
    cells = [[("" if v is None else str(v)).replace("|", "\\|") for v in r] for r in rows]
    return "\n".join(["| " + " | ".join(df.columns) + " |", "|" + "---|" * len(df.columns), *("| " + " | ".join(r) + " |" for r in cells)]) + "\n"


def last_saved(log: DataFrame, key: str, order: str) -> DataFrame:
    """The last record of each key in an append-only log."""
    own = F.struct(*log.columns)
    return log.groupBy(key).agg(F.max_by(own, F.col(order)).alias("__r")).select("__r.*")


def copy_actions(table: DataFrame, source: str, target: str, mode: str, existing: DataFrame) -> DataFrame:
    """What materialising each file would do: keep what is there, report what has no source, else ``mode``."""
    have = existing.select(F.col("path").alias(target), F.lit(True).alias("__there"))
    d = table.join(have, target, "left")
    action = F.when(F.col(source).isNull() | (F.trim(source) == ""), "missing_source").when(F.col("__there"), "exists").otherwise("manifest_only" if mode == "manifest-only" else mode)
    return d.withColumn("action", action).drop("__there")


def materialise(actions: DataFrame, source: str, target: str) -> DataFrame:
    """Carry out link and copy actions on a mounted store; safe to repeat, as each file is replaced whole."""

    def run(batches):
        import os
        import shutil

        for pdf in batches:
            done = []
            for a, s, t in zip(pdf["action"], pdf[source], pdf[target], strict=True):
                if a in ("symlink", "hardlink", "copy"):
                    os.makedirs(PurePosixPath(t).parent, exist_ok=True)
                    spare = f"{t}.part"
                    if os.path.lexists(spare):
                        os.unlink(spare)
                    {"symlink": os.symlink, "hardlink": os.link, "copy": shutil.copyfile}[a](s, spare)
                    os.replace(spare, t)
                done.append(a)
            yield pdf.assign(action=done)

    return actions.repartition(mounts.shares(actions.sparkSession), target).mapInPandas(run, actions.schema)
