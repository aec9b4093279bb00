"""Separable stencils on volumes kept as long rows, and what is built of them.

A stencil goes over one axis after the other. Along an axis each line is a window
ordered by place, and a voxel's sum is one of lags and leads with the stencil's
weights; lines are dealt out, so a large case is no hot group. Lines must be dense:
``dense`` adds absent voxels as 0. What lies beyond a line's ends is 0, the end voxel
again, or the line mirrored; 'valid' leaves out voxels whose stencil does not fit.

Defined results: null values count as 0 in ``dense``; a voxel that stands twice is
summed there; empty tables give no rows; other columns are dropped.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .voxels import AXES, V


def dense(df: DataFrame, shape: Sequence[int], columns: Sequence[str] = (V,), axes: Sequence[str] = AXES) -> DataFrame:
    """Every voxel of each case's box; absent ones are 0. Voxels outside the box are left out."""
    grid = df.select("case").distinct()
    for k, (a, n) in enumerate(zip(axes, shape, strict=True)):
        grid = grid.withColumn(a, F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long"))))
        grid = grid.repartition("case", a) if k == 0 else grid
    own = df.groupBy("case", *(F.col(a).cast("long").alias(a) for a in axes)).agg(*(F.sum(F.col(c).cast("double")).alias(c) for c in columns))
    both = grid.join(own.hint("merge"), ["case", *axes], "left")  # as many rows as voxels, whatever their estimate
    return both.select("case", *axes, *(F.coalesce(c, F.lit(0.0)).alias(c) for c in columns))


def _extended(df: DataFrame, axis: str, n: int, reach: int, edge: str) -> DataFrame:
    """Lines with ``reach`` voxels more at both ends: the end voxel repeated, or the line mirrored about its outer edge."""
    at = F.col(axis)
    if edge == "mirror":
        if reach > n:
            raise ValueError("the stencil reaches beyond the mirrored line")
        copies = F.array(at, -1 - at, F.lit(2 * n - 1) - at)
        copies = F.filter(copies, lambda p: (p >= -reach) & (p < n + reach))
    else:
        ends = [F.when(at == 0, F.sequence(F.lit(-reach).cast("long"), F.lit(-1).cast("long"))), F.when(at == n - 1, F.sequence(F.lit(n).cast("long"), F.lit(n + reach - 1).cast("long")))]
        copies = F.concat(F.array(at), *(F.coalesce(e, F.array().cast("array<bigint>")) for e in ends))
    return df.withColumn(axis, F.explode(copies))


def convolved(df: DataFrame, axis: str, n: int, weights: Sequence[float], columns: Sequence[str] = (V,), edge: str = "zeros", axes: Sequence[str] = AXES) -> DataFrame:
    """Weighted sums along an axis of ``n`` places, the stencil's middle on the voxel. ``edge``: zeros, repeat, mirror or valid."""
    if edge not in ("zeros", "repeat", "mirror", "valid") or len(weights) % 2 == 0:
        raise ValueError(f"unknown edge {edge}, or a stencil without a middle")
    reach = len(weights) // 2
    rows = _extended(df, axis, n, reach, edge) if edge in ("repeat", "mirror") and reach else df
    line = Window.partitionBy("case", *(a for a in axes if a != axis)).orderBy(axis)

    def total(c: str) -> Column:
        terms = [w * (F.col(c) if k == reach else F.lag(c, reach - k, 0.0).over(line)) for k, w in enumerate(weights) if w]
        return reduce(lambda x, y: x + y, terms, F.lit(0.0))

    out = rows.select("case", *axes, *(total(c).alias(c) for c in columns))
    if edge == "valid":
        return out.where((F.col(axis) >= reach) & (F.col(axis) < n - reach)).withColumn(axis, F.col(axis) - reach)
    return out.where((F.col(axis) >= 0) & (F.col(axis) < n)) if edge != "zeros" else out


def separable(df: DataFrame, shape: Sequence[int], weights: Mapping[str, Sequence[float]], columns: Sequence[str] = (V,), edge: str = "zeros", axes: Sequence[str] = AXES) -> DataFrame:
    for a, n in zip(axes, shape, strict=True):
        if a in weights:
            df = convolved(df, a, n, weights[a], columns, edge, axes)
    return df


def gaussian_weights(sigma: float, truncated: float = 4.0) -> list[float]:
    """The normal distribution's share of each voxel, out to ``truncated`` deviations."""
    tail = int(max(sigma * truncated, 0.5) + 0.5)
    t = math.sqrt(0.5) / sigma
    return [max(0.0, 0.5 * (math.erf(t * (x + 0.5)) - math.erf(t * (x - 0.5)))) for x in range(-tail, tail + 1)]


def sampled_gaussian(size: int, sigma: float) -> list[float]:
    """The density at ``size`` places about the middle, scaled to sum 1."""
    g = [math.exp(-(((k - (size - 1) / 2) / sigma) ** 2) / 2) for k in range(size)]
    return [v / sum(g) for v in g]


def gaussian_smooth(df: DataFrame, shape: Sequence[int], sigma: float, edge: str = "zeros") -> DataFrame:
    """Dense rows in, smoothed rows out."""
    w = gaussian_weights(sigma)
    return separable(df, shape, dict.fromkeys(AXES, w), edge=edge)


def gaussian_sharpen(df: DataFrame, shape: Sequence[int], sigma: float = 3.0, finer: float = 1.0, alpha: float = 30.0) -> DataFrame:
    """What smoothing again takes from the smoothed volume, added to it ``alpha`` times."""
    once = gaussian_smooth(df, shape, sigma)
    # Both are carried along the second smoothing's windows, so no join is needed.
    both = once.withColumn("__again", F.col(V))
    w = gaussian_weights(finer)
    for a, n in zip(AXES, shape, strict=True):
        line = Window.partitionBy("case", *(b for b in AXES if b != a)).orderBy(a)
        reach = len(w) // 2
        again = reduce(lambda x, y: x + y, [v * F.lag("__again", reach - k, 0.0).over(line) for k, v in enumerate(w) if v], F.lit(0.0))
        both = both.withColumn("__again", again)
    return both.select("case", *AXES, (F.col(V) + alpha * (F.col(V) - F.col("__again"))).alias(V))


def mean_pooled(df: DataFrame, shape: Sequence[int], columns: Sequence[str], axes: Sequence[str], size: int = 2) -> DataFrame:
    """Means of whole blocks; what is left at the ends is dropped."""
    for a, n in zip(axes, shape, strict=True):
        df = df.where(F.col(a) < n // size * size)
    return df.groupBy("case", *(F.floor(F.col(a) / size).alias(a) for a in axes)).agg(*(F.avg(c).alias(c) for c in columns))


def similarity_maps(df: DataFrame, shape: Sequence[int], a: str, b: str, axes: Sequence[str] = AXES, window: int = 11, sigma: float | None = 1.5, peak: float = 1.0, k: tuple[float, float] = (0.01, 0.03)) -> DataFrame:
    """(case, place, ssim, cs) where the window fits: structural similarity and contrast sensitivity of two columns of dense rows.

    The window is Gaussian, or uniform without a sigma. All five moments go in one pass an axis.
    """
    if min(shape) < window:
        raise ValueError("the window is larger than the image")
    x, y = F.col(a).cast("double"), F.col(b).cast("double")
    rows = df.select("case", *axes, x.alias("mx"), y.alias("my"), (x * x).alias("xx"), (y * y).alias("yy"), (x * y).alias("xy"))
    w = [1 / window] * window if sigma is None else sampled_gaussian(window, sigma)
    m = separable(rows, shape, dict.fromkeys(axes, w), ("mx", "my", "xx", "yy", "xy"), "valid", axes)
    c1, c2 = ((v * peak) ** 2 for v in k)
    mx, my = F.col("mx"), F.col("my")
    cs = (2 * (F.col("xy") - mx * my) + c2) / (F.col("xx") - mx * mx + F.col("yy") - my * my + c2)
    return m.select("case", *axes, ((2 * mx * my + c1) / (mx * mx + my * my + c1) * cs).alias("ssim"), cs.alias("cs"))


def ssim(df: DataFrame, shape: Sequence[int], a: str, b: str, axes: Sequence[str] = AXES, **how) -> DataFrame:
    """(case, ssim): the mean over all windows."""
    return similarity_maps(df, shape, a, b, axes, **how).groupBy("case").agg(F.avg("ssim").alias("ssim"))


#: The exponents of the published five scales.
SCALES = (0.0448, 0.2856, 0.3001, 0.2363, 0.1333)


def ms_ssim(df: DataFrame, shape: Sequence[int], a: str, b: str, axes: Sequence[str] = AXES, scales: Sequence[float] = SCALES, **how) -> DataFrame:
    """(case, ms_ssim): contrast sensitivity at all scales but the last, similarity at the last, each not below 0, to their exponents and multiplied.

    A scale's image is the last one's mean over blocks of two.
    """
    parts = None
    for i, exponent in enumerate(scales):
        last = i == len(scales) - 1
        mean = F.greatest(F.avg("ssim" if last else "cs"), F.lit(0.0))
        one = similarity_maps(df, shape, a, b, axes, **how).groupBy("case").agg(F.pow(mean, F.lit(exponent)).alias("part"))
        parts = one if parts is None else parts.unionByName(one)
        if not last:
            df, shape = mean_pooled(df, shape, (a, b), axes), [n // 2 for n in shape]
    product = F.aggregate(F.collect_list("part"), F.lit(1.0), lambda x, y: x * y)  # as many as scales
    return parts.groupBy("case").agg(product.alias("ms_ssim"))


def sobel_gradients(df: DataFrame, shape: Sequence[int], axes: Sequence[str] = AXES) -> DataFrame:
    """(case, place, a ``g_`` column per axis): half the difference of both neighbours along the axis, smoothed along the others; end voxels are repeated."""
    own = df.select("case", *axes, *(F.col(V).cast("double").alias(f"g_{a}") for a in axes))
    for a, n in zip(axes, shape, strict=True):
        rows = _extended(own, a, n, 1, "repeat")
        line = Window.partitionBy("case", *(b for b in axes if b != a)).orderBy(a)
        near = {b: (F.lag(f"g_{b}", 1, 0.0).over(line), F.col(f"g_{b}"), F.lead(f"g_{b}", 1, 0.0).over(line)) for b in axes}
        sums = [((after - before) / 2 if a == b else (before + 2 * here + after) / 4).alias(f"g_{b}") for b, (before, here, after) in near.items()]
        own = rows.select("case", *axes, *sums).where((F.col(a) >= 0) & (F.col(a) < n))
    return own


def contour(df: DataFrame) -> DataFrame:
    """Rows of ones where a label's voxel has a neighbour, by face, edge or corner, that isn't in it; beyond the box is not. Values are 0 or 1.

    The cube around a voxel is full if along one axis after the other both neighbours are there and have passed so far.
    """
    own = df.where(F.col(V) > 0).select("case", *AXES, F.lit(1.0).alias(V)).dropna().distinct().withColumn("__in", F.lit(True))
    for a in AXES:
        line = Window.partitionBy("case", *(b for b in AXES if b != a)).orderBy(a)
        near = [(at(a, 1).over(line) == F.col(a) + d) & at("__in", 1).over(line) for at, d in ((F.lag, -1), (F.lead, 1))]
        own = own.withColumn("__in", F.col("__in") & F.coalesce(near[0], F.lit(False)) & F.coalesce(near[1], F.lit(False)))
    return own.where(~F.col("__in")).drop("__in")
