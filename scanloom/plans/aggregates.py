"""Aggregation, metric and curve queries."""

from pyspark.sql import functions as F

from scanloom.functions import scalars as s
from scanloom.operators import lesions, metrics

from .registry import register, table


def _r(df, *names, digits=6):
    return df.withColumns({n: F.round(n, digits) for n in names})


@register(
    "a1_summary_rows",
    """
WITH t AS (SELECT s_name AS subject, s_acctbal AS v FROM supplier)
SELECT subject, round(v, 4) AS v FROM t UNION ALL SELECT 'mean', round(avg(v), 4) FROM t UNION ALL SELECT 'std', round(stddev_samp(v), 4) FROM t UNION ALL SELECT 'median', round(median(v), 4) FROM t
""",
)
def summary_rows(spark, d):
    t = table(spark, d, "supplier").select(F.col("s_name").alias("subject"), F.col("s_acctbal").alias("v"))
    return _r(lesions.with_summary(t), "v", digits=4)


#: Line items as lesions of their order ('subject') and return flag ('region').
_LESIONS = """
l AS (SELECT l_orderkey AS subject, l_returnflag AS region, CASE WHEN l_linenumber = 7 THEN NULL ELSE l_quantity END AS volume,
  l_discount < 0.07 AS is_matched, CASE WHEN l_tax > 0.07 THEN NULL ELSE l_discount * 10 END AS dsc, l_tax * 10 AS nsd,
  CASE WHEN l_linenumber = 2 THEN NULL ELSE l_quantity / 4 END AS hd95 FROM lineitem),
f AS (SELECT l_orderkey AS subject, l_returnflag AS region, count(*) FILTER (WHERE l_linenumber = 3) AS fp FROM lineitem GROUP BY 1, 2)
"""


def _lesion_tables(spark, d):
    li = table(spark, d, "lineitem")
    c = F.col
    rows = li.select(
        c("l_orderkey").alias("subject"),
        c("l_returnflag").alias("region"),
        F.when(c("l_linenumber") != 7, c("l_quantity")).alias("volume"),
        (c("l_discount") < 0.07).alias("is_matched"),
        F.when(c("l_tax") <= 0.07, c("l_discount") * 10).alias("dsc"),
        (c("l_tax") * 10).alias("nsd"),
        F.when(c("l_linenumber") != 2, c("l_quantity") / 4).alias("hd95"),
    )
    return rows, li.groupBy(c("l_orderkey").alias("subject"), c("l_returnflag").alias("region")).agg(F.count_if(c("l_linenumber") == 3).alias("fp"))


@register(
    "a3_lesion_aggregate",
    f"""
WITH {_LESIONS}, x AS (SELECT *, volume >= 20 AS lg, is_matched AND coalesce(dsc >= 0.1, FALSE) AS hit, volume >= 20 OR NOT is_matched OR dsc IS NOT NULL AS judged FROM l WHERE volume IS NOT NULL),
g AS (SELECT subject, region, count(*) FILTER (WHERE lg) AS nl, count(*) FILTER (WHERE NOT lg AND judged) AS ns,
  count(*) FILTER (WHERE lg AND hit) AS tl, count(*) FILTER (WHERE lg AND NOT hit) AS fl,
  count(*) FILTER (WHERE NOT lg AND judged AND hit) AS ts, count(*) FILTER (WHERE NOT lg AND judged AND NOT hit) AS fs,
  sum(CASE WHEN is_matched THEN dsc ELSE 0 END) FILTER (WHERE lg) AS sd, count(CASE WHEN is_matched THEN dsc ELSE 0 END) FILTER (WHERE lg) AS nd,
  sum(CASE WHEN is_matched THEN hd95 ELSE 373 END) FILTER (WHERE lg) AS sh, count(CASE WHEN is_matched THEN hd95 ELSE 373 END) FILTER (WHERE lg) AS nh
  FROM x GROUP BY subject, region)
SELECT f.subject, f.region, CASE WHEN coalesce(nl, 0) > 0 THEN round(sd / nullif(nd + fp, 0), 6) END AS dsc,
  CASE WHEN coalesce(nl, 0) > 0 THEN round(coalesce((coalesce(sh, 0) + 373 * fp) / nullif(nh + fp, 0), 373), 5) END AS hd95,
  CASE WHEN coalesce(ns, 0) > 0 THEN ts END AS small_tp, CASE WHEN coalesce(ns, 0) > 0 THEN fs END AS small_fn,
  coalesce(tl, 0) + coalesce(ts, 0) AS tp, coalesce(fl, 0) + coalesce(fs, 0) AS fn, fp
FROM f LEFT JOIN g ON f.subject = g.subject AND f.region = g.region
""",
)
def lesion_aggregate(spark, d):
    a = lesions.aggregate(*_lesion_tables(spark, d))
    return a.select(
        "subject",
        "region",
        F.round("lesionwise_dsc_mean", 6).alias("dsc"),
        F.round("lesionwise_hd95_mean", 5).alias("hd95"),
        F.col("small_instance_tp").alias("small_tp"),
        F.col("small_instance_fn").alias("small_fn"),
        F.col("all_instance_tp").alias("tp"),
        F.col("all_instance_fn").alias("fn"),
        F.col("all_instance_fp").alias("fp"),
    )


@register(
    "a4_lesion_leaderboard_variant",
    f"""
WITH {_LESIONS}, x AS (SELECT *, volume >= 27 AS lg FROM l WHERE volume IS NOT NULL),
g AS (SELECT subject, region, count(*) FILTER (WHERE lg) AS nl,
  sum(CASE WHEN is_matched THEN coalesce(dsc, 0) ELSE 0 END) FILTER (WHERE lg) AS sd, sum(CASE WHEN is_matched THEN coalesce(hd95, 373) ELSE 373 END) FILTER (WHERE lg) AS sh
  FROM x GROUP BY subject, region)
SELECT f.subject, f.region, CASE WHEN nl > 0 THEN round(sd / (nl + fp), 6) END AS dsc, CASE WHEN nl > 0 THEN round((sh + 373 * fp) / (nl + fp), 5) END AS hd95
FROM f LEFT JOIN g ON f.subject = g.subject AND f.region = g.region
""",
)
def leaderboard_variant(spark, d):
    a = lesions.aggregate(*_lesion_tables(spark, d), lesions.TEAM)
    return a.select("subject", "region", F.round("lesionwise_dsc_mean", 6).alias("dsc"), F.round("lesionwise_hd95_mean", 5).alias("hd95"))


@register(
    "a7_a8_f1",
    """
WITH c AS (SELECT l_returnflag AS g, count(*) FILTER (WHERE l_discount > 0.05 AND l_tax > 0.04) AS tp, count(*) FILTER (WHERE l_discount <= 0.05 AND l_tax > 0.04) AS fp,
  count(*) FILTER (WHERE l_discount > 0.05 AND l_tax <= 0.04) AS fn FROM lineitem GROUP BY 1)
SELECT g, round(tp / (tp + fp), 6) AS "precision", round(tp / (tp + fn), 6) AS recall, round(2 * tp / (2 * tp + fp + fn), 6) AS f1 FROM c
""",
)
def f1(spark, d):
    c = metrics.confusion(table(spark, d, "lineitem"), ["l_returnflag"], F.col("l_discount") > 0.05, F.col("l_tax") > 0.04)
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return c.select(
        F.col("l_returnflag").alias("g"), F.round(s.guarded(tp, tp + fp), 6).alias("precision"), F.round(s.guarded(tp, tp + fn), 6).alias("recall"), F.round(s.f1(tp, fp, fn), 6).alias("f1")
    )


@register(
    "a9_missing_subjects",
    "SELECT c_custkey AS subject, coalesce(hd95, 373.0) AS hd95, coalesce(tp, 0) AS tp FROM customer LEFT JOIN (SELECT o_custkey, round(avg(o_totalprice), 2) AS hd95, count(*) AS tp FROM orders GROUP BY o_custkey) ON c_custkey = o_custkey",
)
def missing(spark, d):
    o = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("subject")).agg(F.round(F.avg("o_totalprice"), 2).alias("hd95"), F.count("*").alias("tp"))
    return lesions.fill_missing(o, table(spark, d, "customer").select(F.col("c_custkey").alias("subject")))


@register(
    "a10_pivot",
    "SELECT l_orderkey AS subject, round(max(q) FILTER (WHERE f = 'A'), 2) AS q_A, round(max(q) FILTER (WHERE f = 'N'), 2) AS q_N, round(max(q) FILTER (WHERE f = 'R'), 2) AS q_R FROM (SELECT l_orderkey, l_returnflag AS f, sum(l_quantity) AS q FROM lineitem GROUP BY 1, 2) GROUP BY 1",
)
def pivot(spark, d):
    g = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("subject"), F.col("l_returnflag").alias("region")).agg(F.round(F.sum("l_quantity"), 2).alias("q"))
    return lesions.wide(g, ["A", "N", "R"])


@register(
    "a11_pivot_fill",
    "SELECT o_orderstatus, coalesce(max(n) FILTER (WHERE p = '1-URGENT'), 0) AS urgent, coalesce(max(n) FILTER (WHERE p = '5-LOW'), 0) AS low FROM (SELECT o_orderstatus, o_orderpriority AS p, count(*) AS n FROM orders GROUP BY 1, 2) GROUP BY 1",
)
def pivot_fill(spark, d):
    p = table(spark, d, "orders").groupBy("o_orderstatus").pivot("o_orderpriority", ["1-URGENT", "5-LOW"]).count()
    return p.select("o_orderstatus", F.coalesce("1-URGENT", F.lit(0)).alias("urgent"), F.coalesce("5-LOW", F.lit(0)).alias("low"))


@register(
    "a12_class_report",
    "SELECT l_returnflag, round(avg(l_quantity), 6) AS mean, median(l_quantity) AS median, min(l_quantity) AS min, max(l_quantity) AS max, round(stddev_pop(l_quantity), 6) AS std, count(l_quantity) AS notnans, round(quantile_cont(l_quantity, 0.005), 6) AS p0_5, round(quantile_cont(l_quantity, 0.995), 6) AS p99_5 FROM lineitem GROUP BY 1",
)
def class_report(spark, d):
    return _r(metrics.describe(table(spark, d, "lineitem"), ["l_returnflag"], "l_quantity"), "mean", "std", "p0_5", "p99_5")


@register("a13_mean_of_means", "SELECT round(avg(m), 6) AS value FROM (SELECT l_orderkey, avg(l_discount) AS m FROM lineitem GROUP BY 1)")
def mean_of_means(spark, d):
    return _r(metrics.reduced(table(spark, d, "lineitem"), "l_orderkey", "l_linenumber", "l_discount", "mean"), "value")


@register("a13_mean_batch", "SELECT l_linenumber, round(avg(l_discount), 6) AS value FROM lineitem GROUP BY 1")
def mean_batch(spark, d):
    return _r(metrics.reduced(table(spark, d, "lineitem"), "l_orderkey", "l_linenumber", "l_discount", "mean_batch"), "value")


@register("a13_sum_channel", "SELECT l_orderkey, round(sum(l_discount), 6) AS value FROM lineitem GROUP BY 1")
def sum_channel(spark, d):
    return _r(metrics.reduced(table(spark, d, "lineitem"), "l_orderkey", "l_linenumber", "l_discount", "sum_channel"), "value")


@register("a14_frequencies", "SELECT event_type, count(*) AS n, count(DISTINCT user_id) AS users FROM events GROUP BY 1")
def frequencies(spark, d):
    return table(spark, d, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.count_distinct("user_id").alias("users"))


@register("a15_zero_counts", "SELECT n, count(*) AS cases FROM (SELECT c_custkey, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY 1) GROUP BY 1")
def zero_counts(spark, d):
    n = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n"))
    return metrics.zero_filled(table(spark, d, "customer").select("c_custkey"), n, "c_custkey", "n").groupBy("n").agg(F.count("*").alias("cases"))


@register("a16_literal_counts", "SELECT count(*) FILTER (WHERE o_orderstatus = 'F') AS f, count(*) FILTER (WHERE o_orderstatus = 'O') AS o FROM orders")
def literal_counts(spark, d):
    return table(spark, d, "orders").agg(F.count_if(F.col("o_orderstatus") == "F").alias("f"), F.count_if(F.col("o_orderstatus") == "O").alias("o"))


@register("a17_voxel_volumes", "SELECT l_orderkey, count(*) FILTER (WHERE l_linenumber = 1) AS n_1, count(*) FILTER (WHERE l_linenumber = 2) AS n_2, round(count(*) FILTER (WHERE l_linenumber = 1) * 1.5, 3) AS mm3_1 FROM lineitem GROUP BY 1")
def voxel_volumes(spark, d):
    g = table(spark, d, "lineitem").groupBy("l_orderkey").agg(*(F.count_if(F.col("l_linenumber") == k).alias(f"n_{k}") for k in (1, 2)))
    return g.withColumn("mm3_1", F.round(F.col("n_1") * 1.5e0, 3))


@register("a18_illegal_labels", "SELECT l_orderkey, array_to_string(list_sort(list_filter(list_distinct(list(l_linenumber)), lambda x: x > 4)), ',') AS illegal FROM lineitem GROUP BY 1 HAVING max(l_linenumber) > 4")
def illegal(spark, d):
    allowed = F.array(*(F.lit(k) for k in range(1, 5)))
    g = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.array_except(F.collect_set("l_linenumber"), allowed)).alias("x")).where("size(x) > 0")
    return g.select("l_orderkey", F.concat_ws(",", F.col("x").cast("array<string>")).alias("illegal"))


@register("a19_all_equal", "SELECT l_orderkey, count(DISTINCT l_returnflag) = 1 AS same FROM lineitem GROUP BY 1")
def all_equal(spark, d):
    return table(spark, d, "lineitem").groupBy("l_orderkey").agg((F.count_distinct("l_returnflag") == 1).alias("same"))


@register(
    "a20_confusion",
    "SELECT l_linestatus, count(*) FILTER (WHERE t AND g) AS tp, count(*) FILTER (WHERE NOT t AND g) AS fp, count(*) FILTER (WHERE t AND NOT g) AS fn, count(*) FILTER (WHERE NOT t AND NOT g) AS tn FROM (SELECT l_linestatus, l_discount > 0.05 AS t, l_tax > 0.04 AS g FROM lineitem WHERE l_linenumber <> 7) GROUP BY 1",
)
def confusion(spark, d):
    return metrics.confusion(table(spark, d, "lineitem"), ["l_linestatus"], F.col("l_discount") > 0.05, F.col("l_tax") > 0.04, F.col("l_linenumber") == 7)


@register(
    "a21_a24_confusion_metrics",
    """
WITH c AS (SELECT l_returnflag AS g, CAST(count(*) FILTER (WHERE l_discount > 0.05 AND l_tax > 0.04) AS DOUBLE) AS a, CAST(count(*) FILTER (WHERE l_discount <= 0.05 AND l_tax > 0.04) AS DOUBLE) AS b,
  CAST(count(*) FILTER (WHERE l_discount > 0.05 AND l_tax <= 0.04) AS DOUBLE) AS c, CAST(count(*) FILTER (WHERE l_discount <= 0.05 AND l_tax <= 0.04) AS DOUBLE) AS d FROM lineitem GROUP BY 1)
SELECT g, round(2 * a / (2 * a + b + c), 6) AS dice, round(a / (a + b + c), 6) AS jaccard, round(d / (b + d), 6) AS tnr, round((a + d) / (a + b + c + d), 6) AS acc,
  round((a * d - b * c) / sqrt((a + b) * (a + c) * (d + b) * (d + c)), 6) AS mcc, round(sqrt(a / (a + b) * a / (a + c)), 6) AS fm, round(a / (a + b) + d / (c + d) - 1, 6) AS mk FROM c
""",
)
def confusion_metrics(spark, d):
    c = metrics.confusion(table(spark, d, "lineitem"), ["l_returnflag"], F.col("l_discount") > 0.05, F.col("l_tax") > 0.04)
    m = metrics.confusion_metrics()
    return c.select(F.col("l_returnflag").alias("g"), *(F.round(m[k], 6).alias(k) for k in ("dice", "jaccard", "tnr", "acc", "mcc", "fm", "mk")))


@register("a25_f_beta", "WITH c AS (SELECT l_returnflag AS g, count(*) FILTER (WHERE l_discount > 0.05 AND l_tax > 0.04) AS tp, count(*) FILTER (WHERE l_discount <= 0.05 AND l_tax > 0.04) AS fp, count(*) FILTER (WHERE l_discount > 0.05 AND l_tax <= 0.04) AS fn FROM lineitem GROUP BY 1) SELECT g, round(5 * tp / (5 * tp + 4 * fn + fp), 6) AS f2 FROM c")
def f_beta(spark, d):
    c = metrics.confusion(table(spark, d, "lineitem"), ["l_returnflag"], F.col("l_discount") > 0.05, F.col("l_tax") > 0.04)
    return c.select(F.col("l_returnflag").alias("g"), F.round(metrics.f_beta(2.0, F.col("tp"), F.col("fp"), F.col("fn")), 6).alias("f2"))


@register("a26_smoothed_dice", "SELECT l_returnflag, round((2 * sum(l_discount * l_tax) + 1e-5) / (sum(l_discount) + sum(l_tax) + 1e-5), 6) AS dice FROM lineitem GROUP BY 1")
def smoothed_dice(spark, d):
    return _r(metrics.smoothed_dice(table(spark, d, "lineitem"), ["l_returnflag"], "l_discount", "l_tax"), "dice")


@register("a27_nan_is_one", "SELECT round(avg(v), 6) AS mean, round(avg(coalesce(v, 1)), 6) AS mean_nan_one, round(median(v), 6) AS median FROM (SELECT CASE WHEN l_linenumber = 3 THEN NULL ELSE l_discount END AS v FROM lineitem)")
def nan_is_one(spark, d):
    v = F.when(F.col("l_linenumber") != 3, F.col("l_discount"))
    return table(spark, d, "lineitem").agg(F.round(F.avg(v), 6).alias("mean"), F.round(F.avg(F.coalesce(v, F.lit(1.0))), 6).alias("mean_nan_one"), F.round(F.median(v), 6).alias("median"))


@register("a28_experiment", "SELECT p_brand, p_type, round(avg(p_retailprice), 4) AS score FROM part GROUP BY 1, 2")
def experiment(spark, d):
    return table(spark, d, "part").groupBy("p_brand", "p_type").agg(F.round(F.avg("p_retailprice"), 4).alias("score"))


@register("a29_foreground_mean", "SELECT round(avg(l_quantity), 6) AS foreground_mean FROM lineitem WHERE l_linenumber - 1 NOT IN (0, -1, 99)")
def foreground(spark, d):
    return _r(metrics.foreground_mean(table(spark, d, "lineitem").withColumn("label", F.col("l_linenumber") - 1), "label", "l_quantity"), "foreground_mean")


@register(
    "a30_sample_stats",
    "SELECT user_id, round(avg(value), 6) AS mean, round(median(value), 6) AS median, min(value) AS min, max(value) AS max, round(stddev_pop(value), 6) AS std, count(value) AS notnans, round(quantile_cont(value, 0.1), 6) AS p10, round(quantile_cont(value, 0.9), 6) AS p90 FROM events GROUP BY 1",
)
def sample_stats(spark, d):
    return _r(metrics.describe(table(spark, d, "events"), ["user_id"], "value", (10, 90)), "mean", "median", "std", "p10", "p90")


@register("a31_fingerprint", "SELECT l_linenumber, round(avg(l_extendedprice), 4) AS mean, round(stddev_pop(l_extendedprice), 4) AS std, round(quantile_cont(l_extendedprice, 0.005), 4) AS low, round(quantile_cont(l_extendedprice, 0.995), 4) AS high FROM lineitem GROUP BY 1")
def fingerprint(spark, d):
    v = F.col("l_extendedprice")
    return table(spark, d, "lineitem").groupBy("l_linenumber").agg(F.round(F.avg(v), 4).alias("mean"), F.round(F.stddev_pop(v), 4).alias("std"), F.round(F.percentile(v, 0.005), 4).alias("low"), F.round(F.percentile(v, 0.995), 4).alias("high"))


@register("a32_array_checks", "SELECT l_linenumber, round(avg(CASE WHEN l_discount <> 0 THEN 1 ELSE 0 END), 6) AS nonzero_ratio, TRUE AS all_finite, abs(max(l_discount) - min(l_discount)) <= 1e-8 + 1e-5 * abs(min(l_discount)) AS is_constant FROM lineitem GROUP BY 1")
def array_checks(spark, d):
    return _r(metrics.array_checks(table(spark, d, "lineitem"), ["l_linenumber"], "l_discount"), "nonzero_ratio")


@register("a33_two_level", "SELECT round(avg(m), 6) AS median, round(avg(s), 6) AS stdev FROM (SELECT user_id, median(value) AS m, stddev_pop(value) AS s FROM events GROUP BY 1)")
def two_level(spark, d):
    return _r(metrics.two_level(table(spark, d, "events"), "user_id", "value", {"median": F.median, "stdev": F.stddev_pop}), "median", "stdev")


@register("a34_histogram", "SELECT CAST(floor(l_quantity / 10) AS BIGINT) AS bin, count(*) AS n FROM lineitem GROUP BY 1")
def histogram(spark, d):
    return table(spark, d, "lineitem").groupBy(F.floor(F.col("l_quantity") / 10).alias("bin")).agg(F.count("*").alias("n"))


@register("a35_dataset_summary", "SELECT round(quantile_cont(p_size, 0.5), 4) AS spacing, round(avg(p_retailprice), 4) AS mean, round(stddev_pop(p_retailprice), 4) AS std FROM part")
def dataset_summary(spark, d):
    return table(spark, d, "part").agg(F.round(F.percentile("p_size", 0.5), 4).alias("spacing"), F.round(F.avg("p_retailprice"), 4).alias("mean"), F.round(F.stddev_pop("p_retailprice"), 4).alias("std"))


@register("a36_rms_weights", "SELECT event_type, round(r / sum(r) OVER (), 6) AS weight FROM (SELECT event_type, sqrt(avg(value * value)) AS r FROM events GROUP BY 1)")
def rms(spark, d):
    return metrics.rms_weights(table(spark, d, "events"), "event_type", "value")


@register(
    "a37_image_errors",
    "SELECT l_returnflag, round(mse, 8) AS mse, round(mae, 8) AS mae, round(sqrt(mse), 8) AS rmse, round(10 * log10(1 / mse), 6) AS psnr FROM (SELECT l_returnflag, avg((l_discount - l_tax) ** 2) AS mse, avg(abs(l_discount - l_tax)) AS mae FROM lineitem GROUP BY 1)",
)
def image_errors(spark, d):
    e = metrics.image_errors(table(spark, d, "lineitem"), ["l_returnflag"], "l_discount", "l_tax")
    return _r(_r(e, "mse", "mae", "rmse", digits=8), "psnr")


@register(
    "a38_global_ssim",
    "SELECT l_returnflag, round((2 * avg(l_discount) * avg(l_tax) + 0.0001) * (2 * covar_pop(l_discount, l_tax) + 0.0009) / ((avg(l_discount) ** 2 + avg(l_tax) ** 2 + 0.0001) * (var_pop(l_discount) + var_pop(l_tax) + 0.0009)), 6) AS ssim FROM lineitem GROUP BY 1",
)
def ssim(spark, d):
    return _r(metrics.global_ssim(table(spark, d, "lineitem"), ["l_returnflag"], "l_discount", "l_tax"), "ssim")


@register("a39_mean_correlation", "SELECT round((corr(l_quantity, l_discount) + corr(l_quantity, l_extendedprice) + corr(l_discount, l_extendedprice)) / 3, 6) AS mean_correlation FROM lineitem")
def correlation(spark, d):
    return _r(metrics.mean_correlation(table(spark, d, "lineitem"), ["l_quantity", "l_discount", "l_extendedprice"]), "mean_correlation")


@register(
    "a40_roc_auc",
    """
WITH r AS (SELECT event_type AS g, user_id % 2 = 0 AS t, rank() OVER (PARTITION BY event_type ORDER BY value) + (count(*) OVER (PARTITION BY event_type, value) - 1) / 2.0 AS r FROM events)
SELECT g, round((sum(r) FILTER (WHERE t) - count(*) FILTER (WHERE t) * (count(*) FILTER (WHERE t) + 1) / 2.0) / (count(*) FILTER (WHERE t) * count(*) FILTER (WHERE NOT t)), 6) AS auc FROM r GROUP BY g
""",
)
def auc(spark, d):
    a = metrics.roc_auc(table(spark, d, "events"), ["event_type"], F.col("user_id") % 2 == 0, "value")
    return a.select(F.col("event_type").alias("g"), F.round("auc", 6).alias("auc"))


_CURVE = "SELECT l_linenumber AS g, l_quantity AS x, avg(l_discount) AS y FROM lineitem GROUP BY 1, 2"


@register("a42_curve_area", f"SELECT g, round(sum(a) / (max(x) - min(x)), 6) AS area FROM (SELECT g, x, (x - lag(x) OVER w) * (y + lag(y) OVER w) / 2 AS a FROM ({_CURVE}) WINDOW w AS (PARTITION BY g ORDER BY x)) GROUP BY g")
def curve(spark, d):
    c = table(spark, d, "lineitem").groupBy(F.col("l_linenumber").alias("g"), F.col("l_quantity").alias("x")).agg(F.avg("l_discount").alias("y"))
    return _r(metrics.trapezoid(c, ["g"], "x", "y"), "area")


@register("a43_raw_area", f"SELECT g, round(sum(a), 5) AS area FROM (SELECT g, (x - lag(x) OVER w) * (y + lag(y) OVER w) / 2 AS a FROM ({_CURVE}) WINDOW w AS (PARTITION BY g ORDER BY x)) GROUP BY g")
def raw_curve(spark, d):
    c = table(spark, d, "lineitem").groupBy(F.col("l_linenumber").alias("g"), F.col("l_quantity").alias("x")).agg(F.avg("l_discount").alias("y"))
    return _r(metrics.trapezoid(c, ["g"], "x", "y", normalised=False), "area", digits=5)


@register("a46_weighted_average", "SELECT event_type, round(sum(value * (user_id % 5)) / sum(user_id % 5), 6) AS value FROM events GROUP BY 1")
def weighted(spark, d):
    return _r(metrics.mean_ensemble(table(spark, d, "events").withColumn("w", F.col("user_id") % 5), ["event_type"], "value", "w"), "value")


@register("a48_mean_ensemble", "SELECT l_orderkey, round(avg(l_discount), 6) AS value FROM lineitem GROUP BY 1")
def ensemble(spark, d):
    return _r(metrics.mean_ensemble(table(spark, d, "lineitem"), ["l_orderkey"], "l_discount"), "value")


@register("a49_vote", "SELECT user_id, label FROM (SELECT user_id, label, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, label) AS r FROM (SELECT user_id, length(event_type) AS label, count(*) AS n FROM events GROUP BY 1, 2)) WHERE r = 1")
def vote(spark, d):
    return metrics.vote(table(spark, d, "events").withColumn("label", F.length("event_type").cast("bigint")), ["user_id"], "label")


@register("a50_mask_combine", "SELECT l_orderkey, count(*) FILTER (WHERE l_discount > 0.05) >= 2 AS mask FROM lineitem GROUP BY 1")
def masks(spark, d):
    return metrics.combine_masks(table(spark, d, "lineitem"), ["l_orderkey"], F.col("l_discount") > 0.05, "min2")


@register("a51_max_pool", "SELECT l_returnflag, l_orderkey // 4 AS l_orderkey, CAST(l_linenumber // 4 AS BIGINT) AS l_linenumber, max(l_quantity) AS l_quantity FROM lineitem GROUP BY 1, 2, 3")
def pool(spark, d):
    return metrics.max_pool(table(spark, d, "lineitem"), ["l_returnflag"], ["l_orderkey", "l_linenumber"], "l_quantity")


@register("a52_bounding_box", "SELECT l_suppkey, min(l_linenumber) AS l_linenumber_min, max(l_linenumber) + 1 AS l_linenumber_max, CAST(round_even(avg(l_linenumber), 0) AS INTEGER) AS l_linenumber_mid FROM lineitem GROUP BY 1")
def bounding_box(spark, d):
    return metrics.bounding_box(table(spark, d, "lineitem"), ["l_suppkey"], ["l_linenumber"])
