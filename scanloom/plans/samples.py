"""Queries of crops, curves, scores, late streams, connectors and the sinks of reports."""

from pyspark.sql import functions as F

from scanloom.functions import scalars as s
from scanloom.operators import crops, distances, joins, metrics
from scanloom.operators import windows as w
from scanloom.sources import connectors, mounts, tables, volumes
from scanloom.sources.shared import fresh_folder, written
from scanloom.streaming import streams

from .grids import SHAPE
from .grids import volumes as cubes
from .registry import register, table


def _score(key: str, seed: int) -> str:
    return f"('0x' || substr(sha256('{seed}::' || {key}), 1, 16))::UBIGINT::DOUBLE / 18446744073709551616.0"


# -- draws -----------------------------------------------------------------------


@register(
    "v_weighted_crops",
    f"""WITH o AS (SELECT l_suppkey AS "case", l_orderkey * 100000 + l_partkey AS x, l_linenumber AS y, sum(l_quantity)::BIGINT AS w FROM lineitem GROUP BY ALL),
r AS (SELECT *, sum(w) OVER (PARTITION BY "case" ORDER BY x, y) - w AS low, sum(w) OVER (PARTITION BY "case") AS total FROM o),
d AS (SELECT "case", sample, {_score("\"case\" || '::' || sample", 11)} AS u FROM (SELECT DISTINCT "case" FROM o), range(20) t(sample))
SELECT "case", sample, x, y FROM r JOIN d USING ("case") WHERE u * total >= low AND u * total < low + w""",
)
def weighted_places(spark, d):
    li = table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("case"), (F.col("l_orderkey") * 100000 + F.col("l_partkey")).alias("x"), F.col("l_linenumber").alias("y")).agg(F.sum("l_quantity").alias("weight"))
    return crops.weighted_places(li, 20, 11, ("x", "y")).withColumn("sample", F.col("sample").cast("long"))


@register(
    "w25_random_rows",
    f"""SELECT "case", o_orderkey FROM (SELECT o_custkey AS "case", o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY {_score("o_custkey || '::' || o_orderkey", 5)}, o_orderkey) AS r FROM orders WHERE {_score("'case::' || o_custkey", 5)} < 0.3) WHERE r = 1""",
)
def random_rows(spark, d):
    return crops.random_rows(table(spark, d, "orders").select(F.col("o_custkey").alias("case"), "o_orderkey"), "o_orderkey", 0.3, 5)


@register("v_random_twins")
def random_twins(spark, d):
    """Shift, scale and contrast with a coefficient of each case, then a flip or a quarter turn, on some of the cases."""
    c = cubes(spark, d)
    c = crops.randomly(c, 0.5, 1, lambda k: F.col("value") + k, -0.1, 0.1)
    c = crops.randomly(c, 0.5, 3, lambda k: F.col("value") * (1 + k), -0.5, 0.5)
    last = F.lit(SHAPE[0] - 1)
    return crops.randomly_placed(c, 0.5, 5, [{"x": last - F.col("x")}, {"y": last - F.col("y")}, {"x": last - F.col("y"), "y": F.col("x")}])


# -- scores ----------------------------------------------------------------------

_RANKED = """WITH e AS (SELECT event_type AS g, user_id % 3 = 0 AS t, value FROM events),
r AS (SELECT g, t, rank() OVER (PARTITION BY g ORDER BY value) + (count(*) OVER (PARTITION BY g, value) - 1) / 2.0 AS r, rank() OVER (ORDER BY value) + (count(*) OVER (PARTITION BY value) - 1) / 2.0 AS all_r FROM e),
a AS (SELECT g, count(*) FILTER (WHERE t) AS p, (sum(r) FILTER (WHERE t) - count(*) FILTER (WHERE t) * (count(*) FILTER (WHERE t) + 1) / 2.0) / (count(*) FILTER (WHERE t) * count(*) FILTER (WHERE NOT t)) AS auc FROM r GROUP BY g),
m AS (SELECT (sum(all_r) FILTER (WHERE t) - count(*) FILTER (WHERE t) * (count(*) FILTER (WHERE t) + 1) / 2.0) / (count(*) FILTER (WHERE t) * count(*) FILTER (WHERE NOT t)) AS auc FROM r)"""


@register("a40_averaged_auc", _RANKED + " SELECT 'macro' AS average, round(avg(auc), 6) AS auc FROM a UNION ALL SELECT 'weighted', round(sum(auc * p) / sum(p), 6) FROM a UNION ALL SELECT 'micro', round(auc, 6) FROM m")
def averaged_auc(spark, d):
    e = table(spark, d, "events")
    parts = [metrics.averaged_auc(e, "event_type", F.col("user_id") % 3 == 0, "value", how).select(F.lit(how).alias("average"), F.round("auc", 6).alias("auc")) for how in ("macro", "weighted", "micro")]
    return parts[0].union(parts[1]).union(parts[2])


@register(
    "a25_generalized_dice",
    """WITH c AS (SELECT l_orderkey, l_returnflag, sum(CASE WHEN l_discount > 0.05 AND l_tax > 0.04 THEN 1 ELSE 0 END)::DOUBLE AS i, count(*) FILTER (WHERE l_discount > 0.05)::DOUBLE AS t, count(*) FILTER (WHERE l_tax > 0.04)::DOUBLE AS p FROM lineitem GROUP BY 1, 2),
w AS (SELECT *, CASE WHEN t > 0 THEN 1 / (t * t) END AS own, coalesce(max(CASE WHEN t > 0 THEN 1 / (t * t) END) OVER (PARTITION BY l_orderkey), 0) AS top FROM c),
g AS (SELECT l_orderkey, sum(2 * i * coalesce(own, top)) AS a, sum((t + p) * coalesce(own, top)) AS b, sum(p) AS p FROM w GROUP BY 1)
SELECT l_orderkey, round(CASE WHEN b <> 0 THEN a / b WHEN p = 0 THEN 1 ELSE 0 END, 6) AS dice FROM g""",
)
def generalized_dice(spark, d):
    t = table(spark, d, "lineitem").withColumns({"truth": (F.col("l_discount") > 0.05).cast("int"), "guess": (F.col("l_tax") > 0.04).cast("int")})
    return metrics.generalized_dice(t, "l_orderkey", "l_returnflag", "truth", "guess").withColumn("dice", F.round("dice", 6))


@register("a22_region_means", "SELECT l_shipmode_free AS region, round(avg(v), 6) AS mean FROM (SELECT l_returnflag || l_linestatus AS l_shipmode_free, CASE WHEN l_linenumber = 3 THEN NULL ELSE l_discount END AS v FROM lineitem) GROUP BY 1")
def region_means(spark, d):
    v_ = F.when(F.col("l_linenumber") == 3, F.lit("NaN").cast("double")).otherwise(F.col("l_discount"))
    t = table(spark, d, "lineitem").select(F.concat("l_returnflag", "l_linestatus").alias("region"), v_.alias("v"))
    return metrics.region_means(t, "region", "v").withColumn("mean", F.round("mean", 6))


@register(
    "a44_frechet_distance",
    """WITH a AS (SELECT avg(l_quantity) AS m, var_samp(l_quantity) AS v FROM lineitem WHERE l_returnflag = 'A'), b AS (SELECT avg(l_quantity) AS m, var_samp(l_quantity) AS v FROM lineitem WHERE l_returnflag = 'N')
SELECT round((a.m - b.m) ** 2 + a.v + b.v - 2 * sqrt(a.v * b.v), 6) AS distance FROM a, b""",
)
def frechet(spark, d):
    """Of one feature, where the closed form is that of two normal distributions."""
    t = table(spark, d, "lineitem")
    x = distances.frechet_distance(t.where("l_returnflag = 'A'"), t.where("l_returnflag = 'N'"), ["l_quantity"])
    return spark.createDataFrame([(round(x, 6),)], "distance double")


@register(
    "a44_panoptic_quality",
    """WITH m AS (SELECT l_suppkey, count(*) AS tp, sum(l_discount * 10) AS s FROM lineitem WHERE l_discount > 0.05 AND l_tax > 0.04 GROUP BY 1),
n AS (SELECT l_suppkey, count(*) FILTER (WHERE l_tax > 0.04) AS np, count(*) FILTER (WHERE l_discount > 0.05) AS nt FROM lineitem WHERE l_tax > 0.04 OR l_discount > 0.05 GROUP BY 1)
SELECT l_suppkey, round(coalesce(s / tp, 0), 6) AS sq, round(coalesce(tp / (tp + (np - tp) / 2 + (nt - tp) / 2), 0), 6) AS rq, round(coalesce(s / tp * tp / (tp + (np - tp) / 2 + (nt - tp) / 2), 0), 6) AS pq FROM n LEFT JOIN m USING (l_suppkey)""",
)
def panoptic(spark, d):
    t = table(spark, d, "lineitem")
    pred, truth = F.col("l_tax") > 0.04, F.col("l_discount") > 0.05
    n = lambda ok: t.where(ok).groupBy("l_suppkey").agg(F.count("*").alias("n"))
    q = distances.panoptic_quality(t.where(pred & truth).select("l_suppkey", (F.col("l_discount") * 10).alias("iou")), n(pred), n(truth), ["l_suppkey"])
    return q.select("l_suppkey", *(F.round(c, 6).alias(c) for c in ("sq", "rq", "pq")))


# -- text ------------------------------------------------------------------------


@register("f9_joined_numbers", "SELECT event_id, format('{:.6g}', value * pow(10, event_id % 13 - 6)) || ';' || format('{:.6g}', -value / 3) AS text FROM events WHERE value IS NOT NULL")
def joined_numbers(spark, d):
    e = table(spark, d, "events").where("value IS NOT NULL")
    numbers = F.array(F.col("value") * F.pow(F.lit(10.0), F.col("event_id") % 13 - 6), -F.col("value") / 3)
    return e.select("event_id", s.joined_numbers(numbers).alias("text"))


@register("f16_unit_conversion", "SELECT p_partkey, round(p_size * 25.4, 6) AS mm, round(p_size * 1000000.0, 3) AS um FROM part")
def unit_conversion(spark, d):
    p = table(spark, d, "part")
    return p.select("p_partkey", F.round(F.col("p_size") * s.unit_factor("inch", "millimeter"), 6).alias("mm"), F.round(F.col("p_size") * s.unit_factor("meter", "micrometer"), 3).alias("um"))


# -- joins -----------------------------------------------------------------------


@register(
    "j14_paired_paths",
    "SELECT n AS name, min(p) FILTER (WHERE k) AS ref, min(p) FILTER (WHERE NOT k) AS pred FROM (SELECT p_name || '.nii' AS n, CASE WHEN p_size <= 25 THEN 'ref/' ELSE 'pred/' END || p_partkey || '/' || p_name || '.nii' AS p, p_size <= 25 AS k FROM part) GROUP BY 1 HAVING ref IS NOT NULL AND pred IS NOT NULL",
)
def paired_paths(spark, d):
    p, k = table(spark, d, "part"), F.col("p_partkey").cast("string")
    path = lambda side: F.concat(F.lit(f"{side}/"), k, F.lit("/"), F.col("p_name"), F.lit(".nii")).alias("path")
    return joins.paired_by_name(p.where("p_size <= 25").select(path("ref")), p.where("p_size > 25").select(path("pred")))


@register(
    "j20_points_in_boxes",
    """WITH b AS (SELECT l_orderkey, l_partkey AS id, l_quantity AS x0, l_quantity + 12 AS x1, l_discount AS y0, l_discount + 0.04 AS y1 FROM lineitem), p AS (SELECT l_orderkey, l_suppkey AS id, l_quantity AS x, l_tax AS y FROM lineitem)
SELECT l_orderkey, p.id AS point_id, b.id AS box_id, round(sqrt((x - (x0 + x1) / 2) ** 2 + (y - (y0 + y1) / 2) ** 2), 6) AS distance FROM p JOIN b USING (l_orderkey) WHERE x BETWEEN x0 AND x1 AND y BETWEEN y0 AND y1""",
)
def points_in_boxes(spark, d):
    t, q = table(spark, d, "lineitem"), F.col("l_quantity")
    boxes = t.select("l_orderkey", F.col("l_partkey").alias("id"), q.alias("x0"), (q + 12).alias("x1"), F.col("l_discount").alias("y0"), (F.col("l_discount") + 0.04).alias("y1"))
    points = t.select("l_orderkey", F.col("l_suppkey").alias("id"), q.alias("x"), F.col("l_tax").alias("y"))
    return joins.points_in_boxes(points, boxes, "l_orderkey", 8.0, ("x", "y")).select("l_orderkey", "point_id", "box_id", F.round("distance", 6).alias("distance"))


@register("u9_folds_but_one", "SELECT o_orderkey, part FROM (SELECT o_orderkey, (row_number() OVER (ORDER BY o_orderkey) - 1) % 5 AS part FROM orders) WHERE part IN (0, 1, 3)")
def folds_but_one(spark, d):
    """The partitions of some folds, each its own table, one after another."""
    o = table(spark, d, "orders").select("o_orderkey")
    parts = [streams.sharded(o, "o_orderkey", k, 5).withColumn("part", F.lit(k).cast("long")) for k in (0, 1, 3)]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@register("w8_best_configurations", "SELECT p_type, avg(r) AS mean_rank FROM (SELECT p_type, p_brand, row_number() OVER (PARTITION BY p_brand ORDER BY v DESC, p_type) - 1 AS r FROM (SELECT p_type, p_brand, max(p_retailprice) AS v FROM part GROUP BY 1, 2)) GROUP BY 1")
def best_configurations(spark, d):
    """The best of each item's configurations, then ranks."""
    return w.mean_rank(metrics.best_of(table(spark, d, "part"), ["p_type", "p_brand"], "p_retailprice"), "p_type", "p_brand", "p_retailprice")


# -- streams ---------------------------------------------------------------------

#: Four chunks in the order of time; every eleventh event comes two chunks late.
_CHUNKED = """c AS (SELECT *, least(3, floor(4 * (epoch(ts) - lo) / (hi - lo)))::BIGINT + CASE WHEN event_id % 11 = 0 THEN 2 ELSE 0 END AS chunk
  FROM (SELECT event_id, event_type, date_trunc('second', ts) AS ts FROM events), (SELECT epoch(date_trunc('second', min(ts))) AS lo, epoch(date_trunc('second', max(ts))) AS hi FROM events)),
m AS (SELECT chunk, max(ts) AS top FROM c GROUP BY 1), wm AS (SELECT a.chunk, max(b.top) - INTERVAL 6 HOUR AS mark FROM m a LEFT JOIN m b ON b.chunk < a.chunk GROUP BY 1), final AS (SELECT max(top) - INTERVAL 6 HOUR AS mark FROM m)"""


def _chunks(spark, d):
    e = table(spark, d, "events").select("event_id", "event_type", F.date_trunc("second", F.col("ts").cast("timestamp")).alias("ts"))
    span = e.agg(F.min("ts").cast("double"), F.max("ts").cast("double")).first()
    at = F.least(F.lit(3), F.floor(4 * (F.col("ts").cast("double") - span[0]) / (span[1] - span[0])).cast("int"))
    return written(e.withColumn("chunk", at + F.when(F.col("event_id") % 11 == 0, 2).otherwise(0)))


@register(
    "t10_late_rows",
    f"""WITH {_CHUNKED} SELECT strftime(w, '%Y-%m-%d %H') AS hour, event_type, count(*) AS n FROM (SELECT event_type, wm.mark AS mark, date_trunc('hour', ts) AS w FROM c JOIN wm USING (chunk)) r, final f
WHERE (r.mark IS NULL OR w + INTERVAL 1 HOUR > r.mark) AND w + INTERVAL 1 HOUR <= f.mark GROUP BY ALL""",
)
def late_rows(spark, d):
    """Hours closed by a watermark of six hours, without the rows that came after their hour was closed."""
    folder = fresh_folder(spark, "late")
    query = lambda stream: streams.closed_windows(stream, "ts", "event_type", "1 hour", "6 hours")
    streams.replayed(_chunks(spark, d), "chunk", folder, query, streams.append_log(f"{folder}/log"))
    log = spark.read.schema("start timestamp, event_type string, n long, batch long").parquet(f"{folder}/log")
    return log.select(F.date_format("start", "yyyy-MM-dd HH").alias("hour"), "event_type", "n")


@register(
    "t3_shuffle_buffer",
    "SELECT event_id, row_number() OVER (ORDER BY event_id) - 1 AS came FROM events",
)
def shuffle_buffer(spark, d):
    """Through a buffer of 512: the rows of an epoch, back in the order in which they came."""
    placed = streams.epoch_places(table(spark, d, "events").select("event_id"), "event_id", 0, 1, 512)
    return joins.numbered(placed, ["event_id"], "came").select("event_id", "came")


# -- sources and sinks -----------------------------------------------------------


@register(
    "s19_volume_headers",
    "SELECT s_suppkey, 2 + s_suppkey % 5 AS nx, 3 AS ny, 1 + s_suppkey % 2 AS nz, 1.0 + s_suppkey % 3 AS spacing, 'float32' AS dtype FROM supplier",
)
def volume_headers(spark, d):
    """A file per supplier, written by its executor; then the headers alone."""
    import numpy as np
    import pandas as pd

    def encode(batches):
        for pdf in batches:
            made = []
            for k in pdf["s_suppkey"].tolist():
                shape = (2 + k % 5, 3, 1 + k % 2)
                values = (k + np.arange(np.prod(shape), dtype=np.float32)).reshape(shape)
                made.append(volumes.write_nifti(values, np.diag([1.0 + k % 3, 1, 1, 1])))
            yield pd.DataFrame({"name": [f"{k}.nii" for k in pdf["s_suppkey"]], "content": made})

    folder = connectors.mounted(fresh_folder(spark, "volumes"))
    volumes.write_volumes(table(spark, d, "supplier").select("s_suppkey").mapInPandas(encode, "name string, content binary"), folder)
    h = connectors.volume_headers(spark, folder, files_per_task=100)
    n = F.col("shape")
    return h.where("error IS NULL").select(F.regexp_extract("path", r"(\d+)\.nii", 1).cast("long").alias("s_suppkey"), n[0].cast("long").alias("nx"), n[1].alias("ny"), n[2].cast("long").alias("nz"), F.col("spacing")[0].alias("spacing"), "dtype")


@register(
    "s29_split_rewrite",
    "SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN 'val' ELSE 'train' END AS split, FALSE AS is_backup FROM orders UNION ALL SELECT o_orderkey, 'train', TRUE FROM orders",
)
def split_rewrite(spark, d):
    """A table's split column set anew, and the backup of what it was."""
    folder = connectors.mounted(fresh_folder(spark, "splits"))
    o, schema = table(spark, d, "orders"), "o_orderkey long, split string"
    connectors.write_whole(o.select("o_orderkey", F.lit("train").alias("split")), folder)
    new = connectors.rewrite_column(spark, folder, schema, "o_orderkey", "split", o.where("o_orderkey % 7 = 0").select("o_orderkey", F.lit("val").alias("split")))
    old = spark.read.schema(schema).option("header", "true").csv(f"{folder}.bak")
    return new.withColumn("is_backup", F.lit(False)).unionByName(old.withColumn("is_backup", F.lit(True)))


@register(
    "s27_report_files",
    """WITH r AS (SELECT l_orderkey AS "case", l_returnflag AS class, avg(l_discount) AS v FROM lineitem GROUP BY 1, 2), a AS (SELECT * FROM r UNION ALL SELECT "case", 'mean', avg(v) FROM r GROUP BY 1)
SELECT class, round(avg(v), 6) AS mean, round(median(v), 6) AS median, round(max(v), 6) AS max, round(min(v), 6) AS min, round(quantile_cont(v, 0.9), 6) AS p90, round(stddev_pop(v), 6) AS std, count(v) AS notnans FROM a GROUP BY 1""",
)
def report_files(spark, d):
    """The summary of a metric's report, read back from its file."""
    folder = fresh_folder(spark, "report")
    raw = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("case"), F.col("l_returnflag").alias("class")).agg(F.avg("l_discount").alias("value"))
    tables.write_report(raw, folder, "dice")
    back = tables.csv_typed(spark, f"{folder}/dice_summary", "class string, mean double, median double, max double, min double, p90 double, std double, notnans long")
    return back.select("class", *(F.round(c, 6).alias(c) for c in ("mean", "median", "max", "min", "p90", "std")), "notnans")


@register("s33_missing_files", "SELECT p_partkey FROM part WHERE p_partkey % 4 = 1")
def missing_files(spark, d):
    """Records of a data list against a listing of files that were written and linked."""
    folder = connectors.mounted(fresh_folder(spark, "files"))
    p = table(spark, d, "part").select("p_partkey").repartition(mounts.shares(spark), "p_partkey")  # a small table; its files are many
    k = F.col("p_partkey").cast("string")
    below = F.concat((F.col("p_partkey") % 1000).cast("string"), F.lit("/"), k)
    sources = p.where("p_partkey % 4 <> 1")
    volumes.write_volumes(sources.select(F.concat(below, F.lit(".nii")).alias("name"), k.cast("binary").alias("content")), folder)
    rows = sources.select(F.concat(F.lit(f"{folder}/"), below, F.lit(".nii")).alias("source"), F.concat(F.lit(f"{folder}/cases/"), below, F.lit("/image.nii")).alias("target"))
    none = spark.createDataFrame([], "path string")
    tables.materialise(tables.copy_actions(rows, "source", "target", "hardlink", none), "source", "target").write.format("noop").mode("overwrite").save()
    there = tables.listing(spark, f"{folder}/cases", "*.nii").select(F.regexp_replace("path", "^file:/+", "/").alias("path"))
    asked = p.select(F.concat(F.lit(f"{folder}/cases/"), below, F.lit("/image.nii")).alias("image"))
    return tables.missing_files(asked, ["image"], there).select(F.regexp_extract("path", r"(\d+)/image", 1).cast("long").alias("p_partkey"))


@register("s7_json_objects", "SELECT p_partkey, p_name, p_size FROM part WHERE p_partkey % 3 = 0")
def json_objects(spark, d):
    """A file per part with one indented object; a third are objects, the others lists or broken."""
    folder = connectors.mounted(fresh_folder(spark, "objects"))
    p, k = table(spark, d, "part").repartition(mounts.shares(spark), "p_partkey"), F.col("p_partkey")  # a small table; its files are many
    document = F.to_json(F.struct("p_partkey", "p_name", "p_size"), {"pretty": "true"})
    content = F.when(k % 3 == 0, document).when(k % 3 == 1, F.concat(F.lit("{"), document)).otherwise("[3, 4]")
    volumes.write_volumes(p.select(F.concat((k % 1000).cast("string"), F.lit("/"), k.cast("string"), F.lit(".json")).alias("name"), F.encode(content, "UTF-8").alias("content")), folder)
    return tables.json_object(spark, folder, "p_partkey long, p_name string, p_size int", deep=True).where("p_partkey IS NOT NULL")


@register("s25_json_sink", "SELECT event_id, event_type, CASE WHEN event_id % 5 <> 0 THEN value END AS value FROM events")
def json_sink(spark, d):
    path = fresh_folder(spark, "json")
    e = table(spark, d, "events").select("event_id", "event_type", F.when(F.col("event_id") % 5 != 0, F.col("value")).alias("value"))
    tables.write_json(e, path)
    return tables.json_lines(spark, path, "event_id long, event_type string, value double")


@register("s16_parent_folders", "SELECT 'case=' || n_nationkey AS folder FROM nation WHERE n_nationkey % 3 <> 0")
def parent_folders(spark, d):
    """Folders that hold a volume; those with notes alone don't count."""
    root = fresh_folder(spark, "folders")
    n = table(spark, d, "nation").select(F.col("n_nationkey").alias("case"), "n_name")
    n.where("case % 3 <> 0").select("case", "n_name").write.partitionBy("case").mode("append").text(root)
    n.where("case % 3 = 0").write.partitionBy("case").mode("append").json(root)
    files = tables.listing(spark, root)
    return tables.parent_folders(files, [".txt"]).select(F.element_at(F.split("folder", "/"), -1).alias("folder"))


@register("s13_s14_configurations", "SELECT s_suppkey, CASE WHEN s_suppkey % 2 = 0 THEN 8 ELSE 4 END AS batch_size, CASE WHEN s_suppkey % 3 = 0 THEN 'cuda' ELSE 'cpu' END AS device, 7 AS seed FROM supplier")
def configurations(spark, d):
    """A registry of defaults overlaid by each run's own settings, where those are given."""
    registry_text = "base:\n  batch_size: 4\n  device: cpu\n  seed: 7\n"
    base = tables.yaml_records(spark, registry_text, "batch_size long, device string, seed long")
    k = F.col("s_suppkey")
    runs = table(spark, d, "supplier").select("s_suppkey", F.lit("base").alias("name"), F.when(k % 2 == 0, F.lit(8)).cast("long").alias("batch_size"), F.when(k % 3 == 0, "cuda").alias("device"), F.lit(None).cast("long").alias("seed"))
    return tables.overlaid(base, runs, "name").select("s_suppkey", "batch_size", "device", "seed")


@register("w13_latest_runs", "SELECT user_id, max('logs_' || strftime(ts, '%Y%m%d_%H%M%S') || '_' || event_type) AS latest FROM events WHERE event_type <> 'view' GROUP BY 1")
def latest_runs(spark, d):
    """Each user's last run by the name of its folder."""
    e = table(spark, d, "events").select("user_id", F.concat(F.when(F.col("event_type") == "view", "other_").otherwise("logs_"), F.date_format("ts", "yyyyMMdd_HHmmss"), F.lit("_"), F.col("event_type")).alias("run"))
    return w.latest(e, ["user_id"], "run", "logs_")
