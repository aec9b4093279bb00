"""Queries over dense grids: resampling, stencils, distance fields, instance maps, reports.

The vectors of ``embeddings`` are volumes of 4 x 4 x 4; line items are voxels of their
supplier, or pixels of an image per return flag.
"""

import numpy as np
from pyspark.sql import functions as F

from scanloom.operators import fields, instances, ranks, resample, stencils, suppression
from scanloom.operators import voxels as v

from .registry import register, table

SHAPE = (4, 4, 4)
_E = 'SELECT vec_id AS "case", i // 16 AS x, (i // 4) % 4 AS y, i % 4 AS z, embedding[i + 1]::DOUBLE AS value FROM embeddings, range(64) t(i)'


def volumes(spark, d):
    e = table(spark, d, "embeddings").select(F.col("vec_id").alias("case"), F.posexplode("embedding").alias("i", "value"))
    i = F.col("i").cast("long")
    return e.select("case", F.floor(i / 16).alias("x"), F.floor(i / 4 % 4).alias("y"), (i % 4).alias("z"), F.col("value").cast("double"))


def _rounded(df, digits=5):
    return df.select("case", "x", "y", "z", F.round("value", digits).alias("value"))


# -- resampling ------------------------------------------------------------------


def _resampled_sql(size, place, padding="border", grid="embeddings"):
    """Eight corners of each target voxel's place; ``place`` has an expression of tx, ty, tz per axis."""
    s = [f"least(greatest({p}, 0), 3)" if padding == "border" else p for p in place]
    return f"""
WITH s AS ({_E}), t AS (SELECT vec_id AS "case", tx, ty, tz, round({s[0]}, 9) AS px, round({s[1]}, 9) AS py, round({s[2]}, 9) AS pz
  FROM {grid}, range({size[0]}) a(tx), range({size[1]}) b(ty), range({size[2]}) c(tz)),
c AS (SELECT "case", tx, ty, tz, floor(px)::BIGINT + i AS x, floor(py)::BIGINT + j AS y, floor(pz)::BIGINT + k AS z,
  (1 - abs(px - floor(px) - i)) * (1 - abs(py - floor(py) - j)) * (1 - abs(pz - floor(pz) - k)) AS w FROM t, range(2) a(i), range(2) b(j), range(2) c(k))
SELECT "case", tx AS x, ty AS y, tz AS z, round(sum(w * value), 5) + 0 AS value FROM c JOIN s USING ("case", x, y, z) WHERE w > 0 GROUP BY ALL
"""


@register("v_zoom_linear", _resampled_sql((8, 8, 8), [f"(t{a} + 0.5) / 2 - 0.5" for a in "xyz"]))
def zoom_linear(spark, d):
    return _rounded(resample.resized(volumes(spark, d), SHAPE, (8, 8, 8)))


#: Axes permuted, one flipped, one at half the spacing; partly outside the source.
_AFFINE = [[0, -1, 0, 3], [0, 0, 0.5, 0.25], [1, 0, 0, -1], [0, 0, 0, 1]]


@register("v_affine_linear", _resampled_sql((6, 4, 6), ["3 - ty", "0.5 * tz + 0.25", "tx - 1.0"], "zeros"))
def affine_linear(spark, d):
    e = volumes(spark, d)
    return _rounded(resample.resampled(e, resample.one_plan(e, SHAPE, (6, 4, 6), np.array(_AFFINE)), padding="zeros"))


@register(
    "v_affine_nearest",
    f'SELECT "case", tx AS x, ty AS y, tz AS z, round(value, 5) + 0 AS value FROM (SELECT vec_id AS "case", tx, ty, tz, least(greatest(round_even(0.4 * tx, 0), 0), 3) AS x, 3 - ty AS y, least(greatest(round_even(tz - 0.75, 0), 0), 3) AS z FROM embeddings, range(9) a(tx), range(4) b(ty), range(4) c(tz)) JOIN ({_E}) USING ("case", x, y, z)',
)
def affine_nearest(spark, d):
    e = volumes(spark, d)
    m = np.array([[0.4, 0, 0, 0], [0, -1, 0, 3], [0, 0, 1, -0.75]])
    return _rounded(resample.resampled(e, resample.one_plan(e, SHAPE, (9, 4, 4), m), "nearest"))


def _headers(spark, d):
    """Each vector's header: voxels of 1 + label % 3 by 1 by 2, the second axis reversed."""
    e = table(spark, d, "embeddings")
    zero, one = F.lit(0.0), F.lit(1.0)
    step = (1 + F.col("label") % 3).cast("double")
    affine = F.array(step, zero, zero, F.lit(-7.0), zero, -one, zero, F.lit(4.0), zero, zero, F.lit(2.0), zero, zero, zero, zero, one)
    return e.select(F.col("vec_id").alias("case"), F.array(*(F.lit(n) for n in SHAPE)).alias("shape"), affine.alias("affine"))


@register(
    "v_spacing",
    f"""
WITH s AS ({_E}), h AS (SELECT vec_id AS "case", (1 + label % 3)::DOUBLE AS step FROM embeddings),
t AS (SELECT "case", tx, ty, tz, round(least(tx * 1.5 / step, 3), 9) AS px, round(least(ty * 1.5, 3), 9) AS py, round(least(tz * 0.75, 3), 9) AS pz
  FROM h, range(20) a(tx), range(3) b(ty), range(5) c(tz) WHERE tx < round_even(3 * step / 1.5 + 1, 0)),
c AS (SELECT "case", tx, ty, tz, floor(px)::BIGINT + i AS x, floor(py)::BIGINT + j AS y, floor(pz)::BIGINT + k AS z,
  (1 - abs(px - floor(px) - i)) * (1 - abs(py - floor(py) - j)) * (1 - abs(pz - floor(pz) - k)) AS w FROM t, range(2) a(i), range(2) b(j), range(2) c(k))
SELECT "case", tx AS x, ty AS y, tz AS z, round(sum(w * value), 5) + 0 AS value FROM c JOIN s USING ("case", x, y, z) WHERE w > 0 GROUP BY ALL
""",
)
def spacing(spark, d):
    return _rounded(resample.resampled(volumes(spark, d), resample.spacing_plans(_headers(spark, d), (1.5, 1.5, 1.5))))


@register("v_orientation", f'SELECT "case", 3 - z AS x, x AS y, 3 - y AS z, round(value, 5) + 0 AS value FROM ({_E})')
def oriented(spark, d):
    """Voxel axes that run to A, I and L, brought to R, A and S."""
    affine = np.array([[0, 0, -1.0, 9], [1.5, 0, 0, 0], [0, -2.0, 0, 3], [0, 0, 0, 1]])
    order, flips = resample.reorientation(affine, "RAS")
    return _rounded(resample.reoriented(volumes(spark, d), SHAPE, order, flips))


# -- stencils --------------------------------------------------------------------


def _weights_sql(w):
    return "SELECT * FROM (VALUES " + ", ".join(f"({k - len(w) // 2}, {x!r}::DOUBLE)" for k, x in enumerate(w)) + ") t(k, w)"


def _smooth_sql(source, w, edge="zeros"):
    at = {a: f"{a} + k" for a in "xyz"}
    if edge == "mirror":
        at = {a: f"CASE WHEN {a} + k < 0 THEN -1 - {a} - k WHEN {a} + k > 3 THEN 7 - {a} - k ELSE {a} + k END" for a in "xyz"}
    for a in "xyz":
        own = ", ".join(f"{at[b]} AS s{b}" if b == a else f"{b} AS s{b}" for b in "xyz")
        source = f"""SELECT g."case", g.x, g.y, g.z, sum(g.w * s.value) AS value FROM (SELECT *, {own} FROM ({source}), ({_weights_sql(w)})) g
  JOIN ({source}) s ON s."case" = g."case" AND s.x = g.sx AND s.y = g.sy AND s.z = g.sz GROUP BY ALL"""
    return source


_HALF, _FINE = stencils.gaussian_weights(0.5), stencils.gaussian_weights(0.3)


@register("f22_gaussian_smooth", f'SELECT "case", x, y, z, round(value, 5) + 0 AS value FROM ({_smooth_sql(_E, _HALF)})')
def gaussian_smooth(spark, d):
    return _rounded(stencils.gaussian_smooth(volumes(spark, d), SHAPE, 0.5))


@register("f22_smooth_mirrored", f'SELECT "case", x, y, z, round(value, 5) + 0 AS value FROM ({_smooth_sql(_E, _HALF, "mirror")})')
def smooth_mirrored(spark, d):
    return _rounded(stencils.gaussian_smooth(volumes(spark, d), SHAPE, 0.5, "mirror"))


@register(
    "f22_gaussian_sharpen",
    f'WITH a AS MATERIALIZED ({_smooth_sql(_E, _HALF)}), b AS ({_smooth_sql("SELECT * FROM a", _FINE)}) SELECT a."case", a.x, a.y, a.z, round(a.value + 10 * (a.value - b.value), 5) + 0 AS value FROM a JOIN b USING ("case", x, y, z)',
)
def gaussian_sharpen(spark, d):
    return _rounded(stencils.gaussian_sharpen(volumes(spark, d), SHAPE, 0.5, 0.3, 10.0))


#: Line items of a return flag as an image: discounts and taxes that fall on a pixel.
_SIDE = 192
_IMAGE = f'SELECT l_returnflag AS "case", l_orderkey % {_SIDE} AS x, l_partkey % {_SIDE} AS y, sum(l_discount) AS a, sum(l_tax) AS b FROM lineitem GROUP BY ALL'
_DENSE = f'SELECT "case", x, y, coalesce(a, 0) AS a, coalesce(b, 0) AS b FROM (SELECT * FROM (SELECT DISTINCT l_returnflag AS "case" FROM lineitem), range({_SIDE}) p(x), range({_SIDE}) q(y)) LEFT JOIN ({_IMAGE}) USING ("case", x, y)'


def images(spark, d):
    t = table(spark, d, "lineitem").select(F.col("l_returnflag").alias("case"), (F.col("l_orderkey") % _SIDE).alias("x"), (F.col("l_partkey") % _SIDE).alias("y"), F.col("l_discount").alias("a"), F.col("l_tax").alias("b"))
    return stencils.dense(t, (_SIDE, _SIDE), ("a", "b"), ("x", "y"))


def _maps_sql(name, image, side):
    """Moments in the window, along x and then along y, where it fits."""
    w = f"w AS (SELECT k + 5 AS k, w FROM ({_weights_sql(stencils.sampled_gaussian(11, 1.5))}))" if name == "m0" else ""
    inner = f"""{name}x AS (SELECT "case", x - k AS x, y, sum(w * a) AS mx, sum(w * b) AS my, sum(w * a * a) AS xx, sum(w * b * b) AS yy, sum(w * a * b) AS xy FROM {image}, w WHERE x - k BETWEEN 0 AND {side - 11} GROUP BY ALL),
{name}y AS (SELECT "case", x, y - k AS y, sum(w * mx) AS mx, sum(w * my) AS my, sum(w * xx) AS xx, sum(w * yy) AS yy, sum(w * xy) AS xy FROM {name}x, w WHERE y - k BETWEEN 0 AND {side - 11} GROUP BY ALL),
{name} AS (SELECT "case", x, y, (2 * (xy - mx * my) + 0.0009) / (xx - mx * mx + yy - my * my + 0.0009) AS cs, (2 * mx * my + 0.0001) / (mx * mx + my * my + 0.0001) * (2 * (xy - mx * my) + 0.0009) / (xx - mx * mx + yy - my * my + 0.0009) AS ssim FROM {name}y)"""
    return f"{w}, {inner}" if w else inner


@register("a38_windowed_ssim", f'WITH i0 AS ({_DENSE}), {_maps_sql("m0", "i0", _SIDE)} SELECT "case", round(avg(ssim), 6) AS ssim FROM m0 GROUP BY 1')
def windowed_ssim(spark, d):
    return stencils.ssim(images(spark, d), (_SIDE, _SIDE), "a", "b", ("x", "y")).withColumn("ssim", F.round("ssim", 6))


_PYRAMID = f"i0 AS ({_DENSE})" + "".join(f', i{n} AS (SELECT "case", x // 2 AS x, y // 2 AS y, avg(a) AS a, avg(b) AS b FROM i{n - 1} WHERE x < {2 * (_SIDE >> n)} AND y < {2 * (_SIDE >> n)} GROUP BY ALL)' for n in range(1, 5))
_PARTS = " UNION ALL ".join(f'SELECT "case", pow(greatest(avg({"ssim" if n == 4 else "cs"}), 0), {e}) AS part FROM m{n} GROUP BY 1' for n, e in enumerate(stencils.SCALES))


@register("a38_ms_ssim", f'WITH {_PYRAMID}, {", ".join(_maps_sql(f"m{n}", f"i{n}", _SIDE >> n) for n in range(5))} SELECT "case", round(product(part), 6) AS ms_ssim FROM ({_PARTS}) GROUP BY 1')
def ms_ssim(spark, d):
    return stencils.ms_ssim(images(spark, d), (_SIDE, _SIDE), "a", "b", ("x", "y")).withColumn("ms_ssim", F.round("ms_ssim", 6))


# -- labels and distances --------------------------------------------------------

_L = 'SELECT DISTINCT l_suppkey AS "case", l_quantity::BIGINT % 12 AS x, l_linenumber::BIGINT AS y, l_partkey % 3 AS z FROM lineitem WHERE l_tax > {}'


def labels(spark, d, bar):
    t = table(spark, d, "lineitem").where(F.col("l_tax") > bar)
    return t.select(F.col("l_suppkey").alias("case"), (F.col("l_quantity").cast("long") % 12).alias("x"), F.col("l_linenumber").cast("long").alias("y"), (F.col("l_partkey") % 3).alias("z"), F.lit(1.0).alias("value")).distinct()


@register(
    "v_contour",
    f'WITH l AS ({_L.format(0.01)}) SELECT a."case", a.x, a.y, a.z FROM l a JOIN l b ON a."case" = b."case" AND abs(a.x - b.x) <= 1 AND abs(a.y - b.y) <= 1 AND abs(a.z - b.z) <= 1 GROUP BY ALL HAVING count(*) < 27',
)
def contour(spark, d):
    return stencils.contour(labels(spark, d, 0.01)).select("case", "x", "y", "z")


@register(
    "v_distance_transform",
    f"""WITH l AS ({_L.format(0.01)}), g AS (SELECT "case", x, y, z FROM (SELECT DISTINCT "case" FROM l), range(12) a(x), range(8) b(y), range(3) c(z)), o AS (SELECT * FROM g ANTI JOIN l USING ("case", x, y, z))
SELECT l."case", l.x, l.y, l.z, round(min(sqrt((l.x - o.x) ** 2 + (1.5 * (l.y - o.y)) ** 2 + (2 * (l.z - o.z)) ** 2)), 6) AS value FROM l JOIN o ON l."case" = o."case" GROUP BY ALL""",
)
def distance_transform(spark, d):
    """The planes of line number 0 are empty, so every voxel has a distance."""
    return _rounded(fields.distance_transform(labels(spark, d, 0.01), (12, 8, 3), (1.0, 1.5, 2.0)), 6)


@register(
    "a45_surface_distances",
    f"""WITH p0 AS ({_L.format(0.01)}), t0 AS ({_L.format(0.03)}),
pn AS (SELECT a."case", a.x, a.y, a.z FROM p0 a LEFT JOIN p0 b ON a."case" = b."case" AND abs(a.x - b.x) + abs(a.y - b.y) + abs(a.z - b.z) = 1 GROUP BY ALL HAVING count(b.x) < 6),
tn AS (SELECT a."case", a.x, a.y, a.z FROM t0 a LEFT JOIN t0 b ON a."case" = b."case" AND abs(a.x - b.x) + abs(a.y - b.y) + abs(a.z - b.z) = 1 GROUP BY ALL HAVING count(b.x) < 6),
d AS (SELECT p."case", p.x, p.y, p.z, t.x AS tx, t.y AS ty, t.z AS tz, sqrt((p.x - t.x) ** 2 + (p.y - t.y) ** 2 + (p.z - t.z) ** 2) AS d FROM pn p JOIN tn t ON p."case" = t."case"),
a AS (SELECT "case", max(d) AS m, quantile_cont(d, 0.95) AS q, avg(d) AS v, count(*) FILTER (WHERE d <= 1) AS c, count(*) AS n FROM (SELECT "case", x, y, z, min(d) AS d FROM d GROUP BY ALL) GROUP BY 1),
b AS (SELECT "case", max(d) AS m, quantile_cont(d, 0.95) AS q, avg(d) AS v, count(*) FILTER (WHERE d <= 1) AS c, count(*) AS n FROM (SELECT "case", tx, ty, tz, min(d) AS d FROM d GROUP BY ALL) GROUP BY 1)
SELECT "case", round(greatest(a.m, b.m), 6) AS hd, round(greatest(a.q, b.q), 6) AS hd95, round((a.v + b.v) / 2, 6) AS asd, round((a.c + b.c) / (a.n + b.n), 6) AS nsd FROM a JOIN b USING ("case")""",
)
def surface(spark, d):
    a, b = (instances.boundary(labels(spark, d, bar).drop("value"), ["case"]) for bar in (0.01, 0.03))
    m = fields.surface_metrics(a, b)
    return m.withColumns({c: F.round(c, 6) for c in ("hd", "hd95", "asd", "nsd")})


@register(
    "o9_suppressed_boxes",
    """WITH RECURSIVE b AS (SELECT l_orderkey AS g, l_partkey AS box_id, l_discount AS score, l_quantity AS x0, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_discount DESC, l_partkey, l_quantity) AS r FROM lineitem),
s(g, r, kept, ids) AS (SELECT DISTINCT g, 0::BIGINT, []::DOUBLE[], []::BIGINT[] FROM b UNION ALL
  SELECT s.g, b.r, CASE WHEN len(list_filter(kept, lambda k: abs(k - x0) < 20 AND (20 - abs(k - x0)) / (20 + abs(k - x0)) > 0.5)) = 0 THEN list_append(kept, x0) ELSE kept END,
   CASE WHEN len(list_filter(kept, lambda k: abs(k - x0) < 20 AND (20 - abs(k - x0)) / (20 + abs(k - x0)) > 0.5)) = 0 THEN list_append(ids, box_id) ELSE ids END
  FROM s JOIN b ON b.g = s.g AND b.r = s.r + 1)
SELECT g, unnest(ids) AS box_id, unnest(kept) AS x0 FROM s WHERE r = (SELECT max(r) FROM b WHERE b.g = s.g)""",
)
def suppressed(spark, d):
    b = table(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("g"), F.col("l_partkey").alias("box_id"), F.col("l_discount").alias("score"), F.col("l_quantity").alias("x0"), (F.col("l_quantity") + 20).alias("x1"), F.lit(0.0).alias("y0"), F.lit(1.0).alias("y1")
    )
    return suppression.suppressed(b, "g", 0.5).select("g", "box_id", "x0")


@register("v_probability_peaks")
def peaks(spark, d):
    """Discounts as probabilities on the plane of a supplier."""
    t = table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("case"), (F.col("l_partkey") % 40).alias("x"), F.col("l_quantity").cast("long").alias("y")).agg(F.max("l_discount").alias("value"))
    return suppression.probability_peaks(t, 0.05, 5)


# -- exact quantiles and reports -------------------------------------------------


@register(
    "a30_exact_quantiles",
    "SELECT lang, share, round(quantile_cont(n_chars, [0, 0.005, 0.25, 0.5, 0.995, 1])[i], 6) AS value FROM documents, (SELECT unnest([0, 0.005, 0.25, 0.5, 0.995, 1]) AS share, unnest([1, 2, 3, 4, 5, 6]) AS i) GROUP BY lang, share, i",
)
def exact_quantiles(spark, d):
    q = ranks.quantiles(table(spark, d, "documents"), ["lang"], "n_chars", (0, 0.005, 0.25, 0.5, 0.995, 1))
    return q.withColumn("value", F.round("value", 6))


_REPORT = """
WITH r AS (SELECT user_id % 5 AS "case", value, event_id % 3 AS label FROM events),
p AS (SELECT "case", 'image' AS part, NULL::BIGINT AS label, value FROM r UNION ALL SELECT "case", 'foreground', NULL, value FROM r WHERE label > 0 UNION ALL SELECT "case", 'label', label, value FROM r),
s AS (SELECT "case", part, label, count(*) AS voxels, max(value) AS max, avg(value) AS mean, median(value) AS median, min(value) AS min, stddev_pop(value) AS stdev,
  quantile_cont(value, 0.005) AS percentile_00_5, quantile_cont(value, 0.1) AS percentile_10_0, quantile_cont(value, 0.9) AS percentile_90_0, quantile_cont(value, 0.995) AS percentile_99_5 FROM p GROUP BY 1, 2, 3),
n AS (SELECT "case", count(*) AS n FROM r GROUP BY 1)"""
_STATS = ("max", "mean", "median", "min", "stdev", *ranks.PERCENTILES)


def _report(spark, d):
    e = table(spark, d, "events").select((F.col("user_id") % 5).alias("case"), "value", (F.col("event_id") % 3).alias("label"))
    return ranks.image_report(e)


@register("a34_image_report", _REPORT + ' SELECT "case", part, label, voxels, round(voxels / n, 6) AS share, ' + ", ".join(f"round({c}, 5) AS {c}" for c in _STATS) + ' FROM s JOIN n USING ("case")')
def image_report(spark, d):
    return _report(spark, d).select("case", "part", "label", "voxels", F.round("share", 6).alias("share"), *(F.round(c, 5).alias(c) for c in _STATS))


@register(
    "a35_report_summary",
    _REPORT + " SELECT part, label, count(*) AS cases, max(max) AS max, min(min) AS min, sum(voxels)::BIGINT AS voxels, " + ", ".join(f"round(avg({c}), 5) AS {c}" for c in _STATS if c not in ("max", "min")) + " FROM s GROUP BY 1, 2",
)
def report_summary(spark, d):
    s = ranks.report_summary(_report(spark, d).drop("share"), overrides={"voxels": F.sum})
    return s.select("part", "label", "cases", "max", "min", "voxels", *(F.round(c, 5).alias(c) for c in _STATS if c not in ("max", "min")))


# -- instances -------------------------------------------------------------------


@register(
    "v_overlapped_patches",
    f"""WITH s AS ({_E}), p AS (SELECT "case", x, y, z, value * (1 + px * 4 + py * 2 + pz) AS value, exp(-0.5 * (((x - px - 1) / 0.375) ** 2 + ((y - py - 1) / 0.375) ** 2 + ((z - pz - 1) / 0.375) ** 2)) AS w
  FROM s, range(2) a(px), range(2) b(py), range(2) c(pz) WHERE x BETWEEN px AND px + 2 AND y BETWEEN py AND py + 2 AND z BETWEEN pz AND pz + 2)
SELECT "case", x, y, z, round(sum(value * greatest(w, 0.001)) / sum(greatest(w, 0.001)), 5) + 0 AS value FROM p GROUP BY ALL""",
)
def overlapped_patches(spark, d):
    """Patches of 3 x 3 x 3 at eight corners, each with values of its own, averaged back by their weights."""
    two = F.array(F.lit(0), F.lit(1))
    p = volumes(spark, d)
    for a in v.AXES:
        p = p.withColumn(f"{a}0", F.explode(two)).where((F.col(a) >= F.col(f"{a}0")) & (F.col(a) <= F.col(f"{a}0") + 2)).withColumn(a, F.col(a) - F.col(f"{a}0"))
    p = p.withColumns({"value": F.col("value") * (1 + 4 * F.col("x0") + 2 * F.col("y0") + F.col("z0")), "weight": v.importance((3, 3, 3))})
    return _rounded(v.merged_patches(p))


@register(
    "v_instance_maps",
    f"""WITH l AS (SELECT "case", z AS component, x, y FROM ({_L.format(0.01)})), m AS (SELECT "case", component, round_even(avg(x), 0) AS mx, round_even(avg(y), 0) AS my FROM l GROUP BY 1, 2),
o AS (SELECT "case", component, l.x, l.y, l.x - mx AS h, l.y - my AS v FROM l JOIN m USING ("case", component)), e AS (SELECT "case", component, min(h) AS h0, max(h) AS h1, min(v) AS v0, max(v) AS v1 FROM o GROUP BY 1, 2)
SELECT "case", component, x, y, round(CASE WHEN h < 0 THEN -h / h0 WHEN h > 0 THEN h / h1 ELSE 0 END, 6) + 0 AS h, round(CASE WHEN v < 0 THEN -v / v0 WHEN v > 0 THEN v / v1 ELSE 0 END, 6) + 0 AS v FROM o JOIN e USING ("case", component)""",
)
def instance_maps(spark, d):
    """Planes of a supplier's voxels as its components."""
    m = fields.instance_maps(labels(spark, d, 0.01).select("case", F.col("z").alias("component"), "x", "y"))
    return m.select("case", "component", "x", "y", F.round("h", 6).alias("h"), F.round("v", 6).alias("v"))


@register(
    "v_extreme_points",
    f"""WITH l AS ({_L.format(0.01)}), r AS (SELECT *, """
    + ", ".join(f'row_number() OVER (PARTITION BY "case" ORDER BY {a} {o}, x, y, z) AS {a}_{n}' for a in "xyz" for n, o in (("low", "ASC"), ("high", "DESC")))
    + " FROM l) "
    + " UNION ALL ".join(f"""SELECT "case", '{a}_{n}' AS point, x, y, z FROM r WHERE {a}_{n} = 1""" for a in "xyz" for n in ("low", "high")),
)
def extreme_points(spark, d):
    return fields.extreme_points(labels(spark, d, 0.01))


# -- drawn transforms ------------------------------------------------------------


def _draw(key: str, k: object, seed: int) -> str:
    return f"(('0x' || substr(sha256('{seed}::' || {key} || '::' || {k}), 1, 16))::UBIGINT::DOUBLE / 18446744073709551616.0)"



@register(
    "v_random_affine",
    f"""WITH s AS ({_E}), d AS (SELECT vec_id AS "case", CASE WHEN {_draw("vec_id", 0, 21)} < 0.7 THEN (2 * {_draw("vec_id", 1, 21)} - 1) * 0.6 ELSE 0 END AS a, CASE WHEN {_draw("vec_id", 0, 21)} < 0.7 THEN 1 / (0.8 + 0.4 * {_draw("vec_id", 2, 21)}) ELSE 1 END AS k,
  CASE WHEN {_draw("vec_id", 0, 21)} < 0.7 THEN (2 * {_draw("vec_id", 3, 21)} - 1) * 0.5 ELSE 0 END AS m FROM embeddings),
t AS (SELECT "case", tx, ty, tz, round(least(greatest(k * cos(a) * tx - k * sin(a) * ty + 1.5 - 1.5 * (k * cos(a) - k * sin(a)) + m, 0), 3), 9) AS px,
  round(least(greatest(k * sin(a) * tx + k * cos(a) * ty + 1.5 - 1.5 * (k * sin(a) + k * cos(a)), 0), 3), 9) AS py, round(least(greatest(k * tz + 1.5 - 1.5 * k, 0), 3), 9) AS pz FROM d, range(4) a1(tx), range(4) b1(ty), range(4) c1(tz)),
c AS (SELECT "case", tx, ty, tz, floor(px)::BIGINT + i AS x, floor(py)::BIGINT + j AS y, floor(pz)::BIGINT + l AS z,
  (1 - abs(px - floor(px) - i)) * (1 - abs(py - floor(py) - j)) * (1 - abs(pz - floor(pz) - l)) AS w FROM t, range(2) a2(i), range(2) b2(j), range(2) c2(l))
SELECT "case", tx AS x, ty AS y, tz AS z, round(sum(w * value), 5) + 0 AS value FROM c JOIN s USING ("case", x, y, z) WHERE w > 0 GROUP BY ALL""",
)
def random_affine(spark, d):
    e = volumes(spark, d)
    plan = resample.random_plans(table(spark, d, "embeddings").select(F.col("vec_id").alias("case")), SHAPE, SHAPE, 21, 0.7, 0.6, (0.8, 1.2), (0.5, 0.0, 0.0))
    return _rounded(resample.resampled(e, plan))


@register(
    "v_smooth_field",
    f"""WITH s AS ({_E}), g AS (SELECT vec_id AS "case", x, y, z, 0.5 + {_draw("vec_id", "x || '::' || y || '::' || z", 4)} AS f FROM embeddings, range(2) a(x), range(2) b(y), range(2) c(z)),
f AS (SELECT s."case", s.x, s.y, s.z, sum((CASE WHEN g.x = 1 THEN s.x / 3 ELSE 1 - s.x / 3 END) * (CASE WHEN g.y = 1 THEN s.y / 3 ELSE 1 - s.y / 3 END) * (CASE WHEN g.z = 1 THEN s.z / 3 ELSE 1 - s.z / 3 END) * f) AS f FROM s JOIN g ON g."case" = s."case" GROUP BY ALL)
SELECT "case", x, y, z, round(value * f, 5) + 0 AS value FROM s JOIN f USING ("case", x, y, z)""",
)
def smooth_field(spark, d):
    e = volumes(spark, d)
    return _rounded(resample.field_adjusted(e, resample.smooth_field(e, (2, 2, 2), SHAPE, 4, 0.5, 1.5)))


def _sobel_sql(axis):
    """Sums along one axis after the other, over places held inside the volume."""
    source = f"SELECT * FROM ({_E})"
    for a in "xyz":
        weights = [(-1, -0.5), (1, 0.5)] if a == axis else [(-1, 0.25), (0, 0.5), (1, 0.25)]
        values = ", ".join(f"({k}, {w}::DOUBLE)" for k, w in weights)
        own = ", ".join(f"greatest(least({b} + k, 3), 0) AS s{b}" if a == b else f"{b} AS s{b}" for b in "xyz")
        source = f"""SELECT g."case", g.x, g.y, g.z, sum(g.w * s.value) AS value FROM (SELECT *, {own} FROM ({source}), (SELECT * FROM (VALUES {values}) t(k, w))) g
  JOIN ({source}) s ON s."case" = g."case" AND s.x = g.sx AND s.y = g.sy AND s.z = g.sz GROUP BY ALL"""
    return source


@register(
    "v_sobel_gradients",
    "SELECT * FROM " + " JOIN ".join(f'(SELECT "case", x, y, z, round(value, 5) + 0 AS g_{a} FROM ({_sobel_sql(a)}))' + ("" if a == "x" else ' USING ("case", x, y, z)') for a in "xyz"),
)
def sobel(spark, d):
    g = stencils.sobel_gradients(volumes(spark, d), SHAPE)
    return g.select("case", "x", "y", "z", *(F.round(f"g_{a}", 5).alias(f"g_{a}") for a in v.AXES))


@register(
    "v_foreground_mask",
    f"""WITH s AS ({_E}), m AS (SELECT "case", min(value) AS a, (max(value) - min(value)) / 16 AS w FROM s GROUP BY 1), h AS (SELECT "case", least(floor((value - a) / w), 15) AS k, count(*) AS n, any_value(a) AS a, any_value(w) AS w FROM s JOIN m USING ("case") GROUP BY 1, 2),
c AS (SELECT *, a + (k + 0.5) * w AS c FROM h), b AS (SELECT "case", k, c, sum(n) OVER o AS n0, sum(n * c) OVER o AS s0, sum(n) OVER r AS n1, sum(n * c) OVER r AS s1 FROM c WINDOW o AS (PARTITION BY "case" ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), r AS (PARTITION BY "case" ORDER BY k ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING)),
t AS (SELECT "case", c AS threshold FROM (SELECT *, row_number() OVER (PARTITION BY "case" ORDER BY n0 * n1 * pow(s0 / n0 - s1 / n1, 2) DESC, k) AS r FROM b WHERE n1 IS NOT NULL) WHERE r = 1)
SELECT "case", x, y, z, CASE WHEN value < threshold THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS value FROM s JOIN t USING ("case")""",
)
def foreground_mask(spark, d):
    return _rounded(v.foreground_mask(volumes(spark, d), 16))


@register("v_remapped", f'SELECT "case", x, y, z, round(CASE WHEN value <= -0.2 THEN -1 WHEN value < 0 THEN -1 + (value + 0.2) / 0.2 WHEN value < 0.1 THEN value / 0.1 * 3 ELSE 3 END, 5) + 0 AS value, round(x / 3 - 0.5, 5) + 0 AS c_x FROM ({_E})')
def remapped(spark, d):
    e = v.with_coordinates(v.remapped(volumes(spark, d), [(-0.2, -1.0), (0.0, 0.0), (0.1, 3.0)]), SHAPE)
    return e.select("case", "x", "y", "z", F.round("value", 5).alias("value"), F.round("c_x", 5).alias("c_x"))


_ARRAY = "SELECT vec_id, list_transform(embedding, lambda e: e::DOUBLE) AS s FROM embeddings"


@register(
    "f24_signal_waves",
    f"""SELECT vec_id, i AS place, round(CASE WHEN i >= 20 AND i < 27 THEN 0 ELSE s[i + 1] + 0.3 * sin(2 * pi() * 3 * i / 64) + CASE WHEN i >= 16 AND i < 32 THEN 0.2 * CASE WHEN sin(2 * pi() * 5 * i / 64) > 0 THEN 1 WHEN sin(2 * pi() * 5 * i / 64) < 0 THEN -1 ELSE 0 END ELSE 0 END END, 4) + 0 AS v
FROM ({_ARRAY}), range(64) t(i)""",
)
def signal_waves(spark, d):
    """A sine, a square pulse over a quarter, and a stretch dropped."""
    e = table(spark, d, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("s"))
    s = v.signal_drop(v.signal_wave(v.signal_wave(F.col("s"), 0.3, 3.0), 0.2, 5.0, True, 0.25, 0.25), 0.3125, 0.1)
    return e.select("vec_id", F.posexplode(s).alias("place", "v")).select("vec_id", F.col("place").cast("long"), F.round("v", 4).alias("v"))
