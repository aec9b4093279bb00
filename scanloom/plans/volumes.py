"""Queries over voxel tables: events are the voxels of their user's volume, one row along x."""

from pyspark.sql import functions as F

from scanloom.operators import instances as i
from scanloom.operators import metrics
from scanloom.operators import voxels as v
from scanloom.operators import windows as w

from .registry import register, table
from .series import _SCORE

_V = "SELECT user_id AS \"case\", event_id AS x, CAST(event_id % 7 AS BIGINT) AS y, CAST(event_id % 5 AS BIGINT) AS z, value FROM events"


def voxels(spark, d):
    e = table(spark, d, "events")
    return e.select(F.col("user_id").alias("case"), F.col("event_id").alias("x"), (F.col("event_id") % 7).alias("y"), (F.col("event_id") % 5).alias("z"), "value")


def _one(name, sql, f):
    register(name, f'SELECT x, round(value, 5) AS value FROM ({sql})')(lambda spark, d: f(voxels(spark, d)).select("x", F.round("value", 5).alias("value")))


def _stat(expr: str) -> str:
    return f'SELECT v.x, {expr} AS value FROM ({_V}) v JOIN (SELECT "case", min(value) AS a, max(value) AS b, avg(value) AS m, stddev_pop(value) AS s, quantile_cont(value, 0.05) AS p, quantile_cont(value, 0.95) AS q FROM ({_V}) GROUP BY 1) t USING ("case")'


_one("v_shift", f"SELECT x, value + 3.5 AS value FROM ({_V})", lambda t: v.shift(t, 3.5))
_one("v_shift_by_std", _stat("value + 0.5 * s"), lambda t: v.shift_by_std(t, 0.5))
_one("v_scale", _stat("CASE WHEN b > a THEN (value - a) / (b - a) ELSE 0 END"), v.scale)
_one("v_scale_fixed_mean", _stat("(value - m) * 1.25 + m"), lambda t: v.scale_fixed_mean(t, 0.25))
_one("v_normalise", _stat("(value - m) / CASE WHEN s > 0 THEN s ELSE 1 END"), v.normalise)
_one("v_threshold", f"SELECT x, CASE WHEN value > 40 THEN value ELSE 0 END AS value FROM ({_V})", lambda t: v.threshold(t, 40.0))
_one("v_scale_range", f"SELECT x, least(greatest((value - 10) / 40, 0), 1) AS value FROM ({_V})", lambda t: v.scale_range(t, (10.0, 50.0), (0.0, 1.0), True))
_one("v_clip_percentiles", _stat("least(greatest(value, p), q)"), lambda t: v.percentile_range(t, 5, 95))
_one("v_scale_percentiles", _stat("CASE WHEN q > p THEN (least(greatest(value, p), q) - p) / (q - p) ELSE 0 END"), lambda t: v.percentile_range(t, 5, 95, (0.0, 1.0)))
_one("v_contrast", _stat("pow((value - a) / (b - a + 1e-7), 1.5) * (b - a) + a"), lambda t: v.contrast(t, 1.5))
_one("v_label_mask", f"SELECT x, CASE WHEN value IN (1, 2, 4) THEN 1 ELSE 0 END AS value FROM (SELECT x, y AS value FROM ({_V}))", lambda t: v.label_mask(t.withColumn("value", F.col("y").cast("double")), [1, 2, 4]))
_one("v_map_labels", f"SELECT x, CASE y WHEN 1 THEN 2 WHEN 2 THEN 1 WHEN 4 THEN 3 ELSE y END AS value FROM ({_V})", lambda t: v.map_labels(t.withColumn("value", F.col("y").cast("double")), {1: 2, 2: 1, 4: 3}))
_one("v_label_filter", f"SELECT x, CASE WHEN y IN (2, 3) THEN y ELSE 0 END AS value FROM ({_V})", lambda t: v.label_filter(t.withColumn("value", F.col("y").cast("double")), [2, 3]))


def _places(name, sql, f):
    register(name, sql)(lambda spark, d: f(voxels(spark, d)).select("x", "y", "z", F.round("value", 5).alias("value")))


_places("v_flip", f"SELECT 999999 - x AS x, y, 4 - z AS z, round(value, 5) AS value FROM ({_V})", lambda t: v.flip(t, (1000000, 7, 5), (0, 2)))
_places("v_rotate90", f"SELECT x, 4 - z AS y, y AS z, round(value, 5) AS value FROM ({_V})", lambda t: v.rotate90(t, (1000000, 7, 5), 1, (1, 2)))
_places("v_transpose", f"SELECT z AS x, y, x AS z, round(value, 5) AS value FROM ({_V})", lambda t: v.transpose(t, (2, 1, 0)))
_places("v_crop", f"SELECT x - 10 AS x, y - 1 AS y, z AS z, round(value, 5) AS value FROM ({_V}) WHERE x >= 10 AND x < 5000 AND y BETWEEN 1 AND 5 AND z < 4", lambda t: v.crop(t, (10, 1, 0), (5000, 6, 4)))
_places("v_centre_crop", f"SELECT x - 300 AS x, y - 1 AS y, z - 1 AS z, round(value, 5) AS value FROM ({_V}) WHERE x >= 300 AND x < 700 AND y BETWEEN 1 AND 4 AND z BETWEEN 1 AND 3", lambda t: v.centre_crop(t, (1000, 7, 5), (400, 4, 3)))
_places("v_pad", f"SELECT x + 2 AS x, y + 3 AS y, z AS z, round(value, 5) AS value FROM ({_V})", lambda t: v.pad(t, (2, 3, 0)))
_places("v_crop_foreground", f'SELECT v.x - a AS x, v.y - b AS y, v.z - c AS z, round(value, 5) AS value FROM ({_V}) v JOIN (SELECT "case", min(x) AS a, min(y) AS b, min(z) AS c FROM ({_V}) WHERE value <> 0 GROUP BY 1) USING ("case") WHERE v.x >= a AND v.y >= b AND v.z >= c AND value <> 0', lambda t: v.crop_foreground(t).where("value <> 0"))
_places("v_zoom_double", f"SELECT 2 * x + k AS x, y, z, round(value, 5) AS value FROM ({_V}), (SELECT unnest([0, 1]) AS k)", lambda t: v.zoom_nearest(t, (1000, 7, 5), (2000, 7, 5)))


@register("v_block_mean", f'SELECT "case", x // 100 AS x, y // 100 AS y, z // 100 AS z, round(avg(value), 5) AS value FROM ({_V}) GROUP BY 1, 2, 3, 4')
def block_mean(spark, d):
    return v.block_mean(voxels(spark, d), 100).withColumn("value", F.round("value", 5))


@register("v_foreground_box", f'SELECT "case", min(x) AS x0, min(y) AS y0, min(z) AS z0, max(x) + 1 AS x1, max(y) + 1 AS y1, max(z) + 1 AS z1 FROM ({_V}) WHERE value <> 0 GROUP BY 1')
def foreground_box(spark, d):
    return v.foreground_box(voxels(spark, d))


@register("v_grid_split", f"SELECT least(x // 250, 3) * 3 + least(y // 2, 2) AS block, count(*) AS n FROM ({_V}) GROUP BY 1")
def grid_split(spark, d):
    return v.grid_split(voxels(spark, d), (1000, 7, 5), (4, 3, 1)).groupBy("block").agg(F.count("*").alias("n"))


@register("v_class_indices", f"SELECT (x * 7 + y) * 5 + z AS \"index\", y AS label FROM ({_V})")
def class_indices(spark, d):
    t = voxels(spark, d).withColumn("value", F.col("y"))
    return v.class_indices(t, (1000, 7, 5)).select("index", F.col("value").alias("label"))


@register("v_one_hot", f"SELECT x, CAST(z = 0 AS INTEGER) AS class_0, CAST(z = 1 AS INTEGER) AS class_1, CAST(z = 2 AS INTEGER) AS class_2 FROM ({_V})")
def one_hot(spark, d):
    return v.one_hot(voxels(spark, d).withColumn("value", F.col("z")), 3).select("x", "class_0", "class_1", "class_2")


@register("v_multi_channel", f"SELECT x, y IN (1, 4) AS tc, y IN (1, 2, 4) AS wt, y = 4 AS et FROM ({_V})")
def multi_channel(spark, d):
    return v.multi_channel(voxels(spark, d).withColumn("value", F.col("y"))).select("x", "tc", "wt", "et")


@register("v_gradient", f'SELECT v.x, round((coalesce(u.value, 0) - coalesce(w.value, 0)) / 2, 5) AS value FROM (SELECT "case", x, value FROM ({_V})) v LEFT JOIN ({_V}) u ON u."case" = v."case" AND u.x = v.x + 1 LEFT JOIN ({_V}) w ON w."case" = v."case" AND w.x = v.x - 1')
def gradient(spark, d):
    t = voxels(spark, d).withColumns({"y": F.lit(0).cast("long"), "z": F.lit(0).cast("long")})
    return v.gradient(t, "x").select("x", F.round("value", 5).alias("value"))


_S = "SELECT user_id, list(coalesce(value, 0) ORDER BY event_id) AS s FROM events GROUP BY 1"


def signals(spark, d):
    """Each user's values in the order of the events."""
    own = F.array_sort(F.collect_list(F.struct("event_id", F.coalesce("value", F.lit(0.0)).alias("v"))))
    return table(spark, d, "events").groupBy("user_id").agg(own.alias("r")).select("user_id", F.col("r.v").alias("s"))


def _spread(df, signal):
    return df.select("user_id", F.posexplode(signal).alias("place", "v")).select("user_id", "place", F.round("v", 4).alias("v"))


def _spread_sql(signal: str) -> str:
    return f"SELECT user_id, CAST(unnest(range(0, len(t))) AS INTEGER) AS place, round(unnest(t), 4) AS v FROM (SELECT user_id, {signal} AS t FROM ({_S}))"


_AT = "s[greatest(least(i + {k}, len(s)), 1)]"


@register(
    "v_signal_smooth",
    _spread_sql(f"list_transform(range(1, len(s) + 1), lambda i: (-3 * {_AT.format(k=-2)} + 12 * {_AT.format(k=-1)} + 17 * s[i] + 12 * {_AT.format(k=1)} - 3 * {_AT.format(k=2)}) / 35.0)"),
)
def signal_smooth(spark, d):
    return _spread(signals(spark, d), v.signal_smooth(F.col("s"), v.savitzky_golay(5, 2)))


@register("v_cut_mix", _spread_sql("s[1:2] || list_reverse(s)[3:4] || s[5:]") + " WHERE len(t) >= 4")
def cut_mix(spark, d):
    return _spread(signals(spark, d).where("size(s) >= 4"), v.cut_mix(F.col("s"), F.reverse("s"), 2, 4))


@register("v_signal_shift", _spread_sql("s[len(s) - 2 % len(s) + 1:] || s[1:len(s) - 2 % len(s)]"))
def signal_shift(spark, d):
    return _spread(signals(spark, d), v.signal_shift(F.col("s"), 2))


@register("v_noise")
def noise(spark, d):
    return v.noise(voxels(spark, d), 1.0, 3).groupBy("case").agg(F.avg("value").alias("mean"))


@register("v_components")
def component_sizes(spark, d):
    """Line items of a supplier as voxels; components of those that touch."""
    t = table(spark, d, "lineitem").select(
        F.col("l_suppkey").alias("case"), F.lit(1).alias("label"), F.col("l_quantity").cast("int").alias("x"), F.col("l_linenumber").alias("y"), (F.col("l_discount") * 100).cast("int").alias("z")
    ).distinct()
    return i.components(t).groupBy("case", "component").agg(F.count("*").alias("n"))


def _parts(spark, d, bar):
    t = table(spark, d, "lineitem").where(F.col("l_tax") > bar).select(
        F.col("l_suppkey").alias("case"), F.lit(1).alias("label"), F.col("l_quantity").cast("int").alias("x"), F.col("l_linenumber").alias("y"), F.lit(0).alias("z")
    )
    return i.components(t.distinct())


@register("j16_greedy_match")
def greedy_match(spark, d):
    return i.match(i.overlaps(_parts(spark, d, 0.01), _parts(spark, d, 0.03)), 0.1, "global")


@register("j17_match_by_prediction")
def match_by_prediction(spark, d):
    return i.match(i.overlaps(_parts(spark, d, 0.01), _parts(spark, d, 0.03)), 0.1, "prediction")


@register("j18_maximal_match")
def maximal_match(spark, d):
    return i.match(i.overlaps(_parts(spark, d, 0.01), _parts(spark, d, 0.03)), 1e-6, "maximal", by="dice")


@register(
    "a41_froc",
    """WITH e AS (SELECT value AS s, count(*) FILTER (WHERE user_id % 3 = 0) AS h, count(*) FILTER (WHERE user_id % 3 <> 0) AS m FROM events GROUP BY 1),
c AS (SELECT sum(m) OVER (ORDER BY s DESC) / 100 AS fps, sum(h) OVER (ORDER BY s DESC) / 5000 AS sens FROM e), u AS (SELECT fps, max(sens) AS sens FROM c GROUP BY 1),
r AS (SELECT unnest([0.25, 0.5, 1.0, 2.0, 4.0, 8.0])::DOUBLE AS rate),
n AS (SELECT rate, coalesce(max(fps) FILTER (WHERE fps <= rate), 0) AS f0, coalesce(arg_max(sens, fps) FILTER (WHERE fps <= rate), 0) AS s0, min(fps) FILTER (WHERE fps > rate) AS f1, arg_min(sens, fps) FILTER (WHERE fps > rate) AS s1 FROM r, u GROUP BY 1)
SELECT rate, CASE WHEN f1 IS NULL THEN s0 ELSE s0 + (s1 - s0) * (rate - f0) / (f1 - f0) END AS sensitivity FROM n""",
)
def froc(spark, d):
    e = table(spark, d, "events").select(F.col("value").alias("score"), (F.col("user_id") % 3 == 0).alias("is_hit"))
    return metrics.froc(e, 100, 5000)


@register("o11_top_patches", f'SELECT "case", px, rank, round(total, 4) AS total FROM (SELECT *, row_number() OVER (PARTITION BY "case" ORDER BY total DESC, px, py, pz) AS rank FROM (SELECT "case", x // 500 AS px, y // 500 AS py, z // 500 AS pz, sum(value) AS total FROM ({_V}) GROUP BY 1, 2, 3, 4)) WHERE rank <= 2')
def top_patches(spark, d):
    return i.top_patches(voxels(spark, d), "case", 500, 2).select("case", "px", "rank", F.round("total", 4).alias("total"))


@register(
    "w4_locked_split",
    f"""SELECT o_orderkey, 'test' AS split FROM orders WHERE o_orderkey % 10 = 0 UNION ALL
SELECT o_orderkey, CASE WHEN row_number() OVER (ORDER BY sc, o_orderkey) <= round_even(count(*) OVER () * 0.2, 0) THEN 'val' ELSE 'train' END
FROM (SELECT o_orderkey, {_SCORE} AS sc FROM orders WHERE o_orderkey % 10 <> 0)""",
)
def locked_split(spark, d):
    o = table(spark, d, "orders")
    legacy = o.where("o_orderkey % 10 = 0").select("o_orderkey", F.lit("val").alias("legacy"))
    return w.locked_split(o.select("o_orderkey"), legacy, "o_orderkey", 20260530, 0.2)


@register("w8_best_of_configurations", "SELECT p_brand, p_type, max(p_retailprice) AS v FROM part GROUP BY 1, 2")
def best_of(spark, d):
    return table(spark, d, "part").groupBy("p_brand", "p_type").agg(F.max("p_retailprice").alias("v"))


@register("w23_weighted_sample", f"SELECT p_partkey FROM part WHERE p_retailprice > 0 ORDER BY -ln(greatest({_SCORE.replace('20260530', '7').replace('o_orderkey', 'p_partkey')}, 1e-18)) / p_retailprice, p_partkey LIMIT 50")
def weighted_sample(spark, d):
    return w.weighted_sample(table(spark, d, "part"), "p_partkey", "p_retailprice", 50, 7).select("p_partkey")
