"""Sources and sinks: tables written below the shared folder and read back through them."""

from pyspark.sql import functions as F

from scanloom.sources import tables, volumes
from scanloom.sources.shared import fresh_folder

from .registry import register, table


@register("s1_s23_typed_csv", "SELECT event_id, CASE WHEN event_id % 7 <> 0 THEN value END AS value, event_type FROM events")
def typed_csv(spark, d):
    path = fresh_folder(spark, "csv")
    e = table(spark, d, "events").withColumn("value", F.when(F.col("event_id") % 7 == 0, F.lit("NaN").cast("double")).otherwise(F.col("value")))
    tables.write_csv(e.select("event_type", "event_id", "value"), path, ["event_id"])
    return tables.csv_typed(spark, path, "event_id long, event_type string, value double")


@register("s2_s24_text_csv", "SELECT CAST(p_partkey AS VARCHAR) AS p_partkey, p_brand, CAST(p_size AS VARCHAR) AS p_size FROM part")
def text_csv(spark, d):
    path = fresh_folder(spark, "csv")
    tables.write_csv(table(spark, d, "part").select("p_size", "p_brand", "p_partkey"), path, ["p_partkey"])
    return tables.mapping_csv(spark, path, ["p_partkey", "p_brand"])


@register("s4_joined_csv", "SELECT c_custkey, n_name, c_acctbal FROM customer JOIN nation ON c_nationkey = n_nationkey")
def joined_csv(spark, d):
    left, right = fresh_folder(spark, "csv"), fresh_folder(spark, "csv")
    tables.write_csv(table(spark, d, "customer").select("c_custkey", F.col("c_nationkey").alias("nation"), "c_acctbal"), left)
    tables.write_csv(table(spark, d, "nation").select(F.col("n_nationkey").alias("nation"), "n_name"), right)
    return tables.csv_joined(spark, [left, right], columns=["c_custkey", "n_name", "c_acctbal"], types={"c_custkey": "long", "c_acctbal": "double"})


@register("s8_s25_json_lines", "SELECT event_id, event_type, value FROM events WHERE event_id % 5 <> 4")
def json_lines(spark, d):
    path = fresh_folder(spark, "json")
    e = table(spark, d, "events")
    good = F.to_json(F.struct("event_id", "event_type", "value"), {"ignoreNullFields": "false"})
    line = F.when(F.col("event_id") % 5 < 4, good).when(F.col("event_id") % 2 == 0, "{broken").otherwise("")
    e.select(line.alias("value")).write.text(path)
    return tables.json_lines(spark, path, "event_id long, event_type string, value double")


@register("s10_split_documents", "SELECT CAST(0 AS INTEGER) AS fold, CASE WHEN p_partkey % 10 = 0 THEN 'val' ELSE 'train' END AS split, CAST(p_partkey AS VARCHAR) AS id FROM part")
def split_documents(spark, d):
    """A document for each brand and 5,000 numbers of parts, since a document has to fit a row."""
    path = fresh_folder(spark, "split")
    p = table(spark, d, "part").withColumn("id", F.col("p_partkey").cast("string"))
    ids = lambda ok: F.collect_list(F.when(ok, F.col("id")))
    docs = p.groupBy("p_brand", F.floor(F.col("p_partkey") / 5000)).agg(ids(F.col("p_partkey") % 10 != 0).alias("train"), ids(F.col("p_partkey") % 10 == 0).alias("val"))
    docs.select(F.to_json(F.struct("train", "val")).alias("value")).write.text(path)
    return tables.split_documents(spark.read.text(path))


@register("s11_s12_datalist", "SELECT '/data/' || p_partkey || '.nii' AS image, '/data/' || p_partkey || '-seg.nii' AS label, CASE WHEN p_partkey % 5 = 2 THEN 'val' ELSE 'train' END AS split FROM part")
def datalist(spark, d):
    path = fresh_folder(spark, "datalist")
    k = F.col("p_partkey").cast("string")
    record = F.struct(F.concat(k, F.lit(".nii")).alias("image"), F.concat(k, F.lit("-seg.nii")).alias("label"), F.when(F.col("p_partkey") % 6 != 5, F.col("p_partkey") % 5).alias("fold"))
    docs = table(spark, d, "part").withColumn("fold5", F.col("p_partkey") % 5).withColumn("r", record)
    docs = docs.withColumn("r", F.when(F.col("fold5") == 2, F.col("r").withField("fold", F.lit(2).cast("long"))).otherwise(F.col("r")))
    docs.groupBy("p_brand", F.floor(F.col("p_partkey") / 5000)).agg(F.to_json(F.struct(F.collect_list("r").alias("training"))).alias("value")).select("value").write.text(path)
    train, val = tables.fold_parts(tables.datalist(spark.read.text(path), "training", "/data"), 2)
    own = ["image", "label"]
    return train.select(*own, F.lit("train").alias("split")).union(val.select(*own, F.lit("val").alias("split")))


@register("s26_last_saved", "SELECT user_id, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS r FROM events) WHERE r = 1")
def last_saved(spark, d):
    path = fresh_folder(spark, "log")
    e = table(spark, d, "events").select("user_id", "event_id", "value")
    for part in (0, 1):  # appended to, as a log is
        tables.write_csv(e.where(F.col("event_id") % 2 == part), path, ["event_id", "user_id", "value"], mode="append")
    return tables.last_saved(tables.csv_typed(spark, path, "event_id long, user_id long, value double"), "user_id", "event_id").select("user_id", "event_id", "value")


@register("s16_s18_case_folders", "SELECT 'case-' || n_nationkey AS folder, CASE WHEN n_nationkey % 3 = 0 THEN 't2w' ELSE '' END AS missing, n_nationkey % 3 <> 0 AS complete FROM nation")
def case_folders(spark, d):
    root = fresh_folder(spark, "cases")
    n = table(spark, d, "nation")
    case = F.concat(F.lit("case-"), F.col("n_nationkey").cast("string"))
    for m in ("t1n", "t2w"):  # a file for each case and modality, in a folder of its own
        own = n.where("n_nationkey % 3 <> 0") if m == "t2w" else n
        own.select(case.alias("case"), F.lit(m).alias("modality"), F.col("n_name").alias("value")).write.partitionBy("case", "modality").mode("append").text(root)
    at = [F.regexp_extract("path", r"case=([^/]+)/modality=([^/]+)/", i) for i in (1, 2)]
    files = tables.listing(spark, root, "*.txt").select(F.concat(at[0], F.lit("/x-"), at[1], F.lit(".nii")).alias("path"))
    found = tables.completeness(tables.modality_files(files, ["t1n", "t2w"]), ["t1n", "t2w"])
    return found.select("folder", "missing", "complete")


@register("s19_s22_volumes", "SELECT n_nationkey, 2 + n_nationkey % 3 AS nx, CAST(24 AS DOUBLE) AS total FROM nation")
def volume_files(spark, d):
    """Volumes encoded as NIfTI-1 and read back: their header and the sum of their voxels."""
    import numpy as np
    import pandas as pd

    def encode(batches):
        for pdf in batches:
            made = [volumes.write_nifti(np.full((2 + int(k) % 3, 2, 2), 24 / (4 * (2 + int(k) % 3)), np.float32), np.eye(4)) for k in pdf["n_nationkey"]]
            yield pd.DataFrame({"path": [f"{k}.nii.gz" for k in pdf["n_nationkey"]], "content": made})

    files = table(spark, d, "nation").select("n_nationkey").mapInPandas(encode, "path string, content binary")
    path = fresh_folder(spark, "volumes")
    files.write.parquet(path)
    files = spark.read.schema("path string, content binary").parquet(path)
    key = F.split("path", r"\.")[0].cast("long").alias("n_nationkey")
    total = volumes.voxels(files).groupBy("path").agg(F.round(F.sum("value"), 3).alias("total"))
    return volumes.headers(files).join(total, "path").select(key, F.col("shape")[0].cast("long").alias("nx"), "total")


@register("s30_s33_materialise", "SELECT p_partkey, CASE WHEN p_partkey % 4 = 0 THEN 'missing_source' WHEN p_partkey % 3 = 0 THEN 'exists' ELSE 'symlink' END AS action FROM part")
def materialise(spark, d):
    k = F.col("p_partkey").cast("string")
    p = table(spark, d, "part").select("p_partkey", F.when(F.col("p_partkey") % 4 != 0, F.concat(F.lit("in/"), k)).otherwise(F.lit(" ")).alias("source"), F.concat(F.lit("out/"), k).alias("target"))
    there = p.where("p_partkey % 3 = 0").select(F.col("target").alias("path"))
    return tables.copy_actions(p, "source", "target", "symlink", there).select("p_partkey", "action")
