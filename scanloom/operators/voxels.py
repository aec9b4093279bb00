"""Array transforms on volumes kept as long rows (case, x, y, z, value).

Intensity transforms are column arithmetic over statistics per case, which are
aggregated once and joined back; spatial ones are coordinate arithmetic. Random
ones draw from a hash of seed, case and place, so a lost task makes the same
voxels again. Absent voxels count as 0 where a transform looks at neighbours.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .instances import components
from .metrics import quantile

AXES = ("x", "y", "z")
V = "value"


def _schema(df: DataFrame) -> str:
    return ", ".join(f"{n} {t}" for n, t in df.dtypes)


def uniform(seed: int, *columns: Column | str) -> Column:
    """A number in [0, 1) that depends on the seed and the columns alone."""
    return (F.xxhash64(F.lit(seed), *columns).bitwiseAND(F.lit((1 << 53) - 1)) / float(1 << 53)).cast("double")


def gaussian(seed: int, *columns: Column | str) -> Column:
    """Standard normal, by the Box-Muller transform."""
    u, v = F.greatest(uniform(seed, *columns), F.lit(1e-300)), uniform(seed + 1, *columns)
    return F.sqrt(-2 * F.ln(u)) * F.cos(2 * np.pi * v)


def with_stats(df: DataFrame, stats: Mapping[str, Column], by: Sequence[str] = ("case",)) -> DataFrame:
    """Adds aggregates of each group to its rows: one partial aggregation and a join."""
    return df.join(df.groupBy(*by).agg(*(c.alias(k) for k, c in stats.items())), list(by))


def changed(df: DataFrame, value: Column) -> DataFrame:
    return df.withColumn(V, value)


# -- intensity -------------------------------------------------------------------


def shift(df: DataFrame, offset: float) -> DataFrame:
    return changed(df, F.col(V) + offset)


def shift_by_std(df: DataFrame, factor: float) -> DataFrame:
    return changed(with_stats(df, {"__s": F.stddev_pop(V)}), F.col(V) + factor * F.col("__s")).drop("__s")


def scale(df: DataFrame, low: float = 0.0, high: float = 1.0) -> DataFrame:
    """To [low, high]; a constant case becomes ``low``."""
    d = with_stats(df, {"__a": F.min(V), "__b": F.max(V)})
    return changed(d, F.when(F.col("__b") > F.col("__a"), (F.col(V) - F.col("__a")) / (F.col("__b") - F.col("__a")) * (high - low) + low).otherwise(low)).drop("__a", "__b")


def scale_by(df: DataFrame, factor: float) -> DataFrame:
    return changed(df, F.col(V) * (1 + factor))


def scale_fixed_mean(df: DataFrame, factor: float) -> DataFrame:
    """Scaled about each case's mean."""
    return changed(with_stats(df, {"__m": F.avg(V)}), (F.col(V) - F.col("__m")) * (1 + factor) + F.col("__m")).drop("__m")


def normalise(df: DataFrame, nonzero: bool = False, channel: Sequence[str] = ()) -> DataFrame:
    """Zero mean and unit population deviation, of the nonzero voxels if asked for."""
    own = F.when(F.col(V) != 0, F.col(V)) if nonzero else F.col(V)
    d = with_stats(df, {"__m": F.avg(own), "__s": F.stddev_pop(own)}, ("case", *channel))
    z = (F.col(V) - F.col("__m")) / F.when(F.col("__s") > 0, F.col("__s")).otherwise(1.0)
    return changed(d, F.when(F.lit(nonzero) & (F.col(V) == 0), 0.0).otherwise(z)).drop("__m", "__s")


def threshold(df: DataFrame, bar: float, above: bool = True, other: float = 0.0) -> DataFrame:
    return changed(df, F.when(F.col(V) > bar if above else F.col(V) < bar, F.col(V)).otherwise(other))


def scale_range(df: DataFrame, a: tuple[float, float], b: tuple[float, float], clip: bool = False) -> DataFrame:
    v = (F.col(V) - a[0]) / (a[1] - a[0]) * (b[1] - b[0]) + b[0] if a[1] != a[0] else F.col(V) - a[0] + b[0]
    return changed(df, F.least(F.greatest(v, F.lit(b[0])), F.lit(b[1])) if clip else v)


def percentile_range(df: DataFrame, low: float, high: float, to: tuple[float, float] | None = None, clip: bool = True, accuracy: int | None = None) -> DataFrame:
    """Clipped to percentiles of each case, and scaled to ``to`` if given."""
    d = with_stats(df, {"__a": quantile(V, low / 100, accuracy), "__b": quantile(V, high / 100, accuracy)})
    a, b = F.col("__a"), F.col("__b")
    v = F.least(F.greatest(F.col(V), a), b) if clip else F.col(V)
    if to is not None:
        v = F.when(b > a, (v - a) / (b - a) * (to[1] - to[0]) + to[0]).otherwise(to[0])
    return changed(d, v).drop("__a", "__b")


def contrast(df: DataFrame, gamma: float) -> DataFrame:
    d = with_stats(df, {"__a": F.min(V), "__b": F.max(V)})
    span = F.col("__b") - F.col("__a")
    return changed(d, F.pow((F.col(V) - F.col("__a")) / (span + 1e-7), F.lit(gamma)) * span + F.col("__a")).drop("__a", "__b")


def masked(df: DataFrame, mask: DataFrame) -> DataFrame:
    """Values where the mask has a voxel, else 0."""
    m = mask.select("case", *AXES, F.lit(True).alias("__m"))
    return changed(df.join(m, ["case", *AXES], "left"), F.when(F.col("__m"), F.col(V)).otherwise(0.0)).drop("__m")


def noise(df: DataFrame, std: float, seed: int, mean: float = 0.0) -> DataFrame:
    return changed(df, F.col(V) + mean + std * gaussian(seed, "case", *AXES))


def rician_noise(df: DataFrame, std: float, seed: int) -> DataFrame:
    a, b = F.col(V) + std * gaussian(seed, "case", *AXES), std * gaussian(seed + 2, "case", *AXES)
    return changed(df, F.sqrt(a * a + b * b))


def histogram_normalise(df: DataFrame, bins: int = 256, low: float = 0.0, high: float = 255.0) -> DataFrame:
    """Each value to its share of the case's histogram so far, scaled to [low, high]."""
    d = with_stats(df, {"__a": F.min(V), "__b": F.max(V), "__n": F.count("*")})
    span = F.col("__b") - F.col("__a")
    d = d.withColumn("__k", F.when(span > 0, F.least(F.floor((F.col(V) - F.col("__a")) / span * bins), F.lit(bins - 1))).otherwise(0))
    w = Window.partitionBy("case").orderBy("__k").rowsBetween(Window.unboundedPreceding, 0)
    share = d.groupBy("case", "__k").agg(F.count("*").alias("__c")).withColumn("__c", F.sum("__c").over(w))
    return changed(d.join(share, ["case", "__k"]), low + F.col("__c") / F.col("__n") * (high - low)).drop("__a", "__b", "__n", "__k", "__c")


def otsu_thresholds(df: DataFrame, bins: int = 256) -> DataFrame:
    """(case, threshold): the middle of the bin at which a case's histogram falls into two classes of the largest variance between them.

    The first one on ties; null for a case of one value. Windows run over bins, of which a case has ``bins``.
    """
    d = with_stats(df.where(F.col(V).isNotNull() & ~F.isnan(V)), {"__a": F.min(V), "__b": F.max(V)}).where("__b > __a")
    width = (F.col("__b") - F.col("__a")) / bins
    at = F.least(F.floor((F.col(V) - F.col("__a")) / width), F.lit(bins - 1))
    h = d.groupBy("case", at.alias("k")).agg(F.count("*").alias("n"), F.first("__a").alias("a"), F.first(width).alias("w"))
    h = h.withColumn("c", F.col("a") + (F.col("k") + 0.5) * F.col("w"))
    so_far = Window.partitionBy("case").orderBy("k").rowsBetween(Window.unboundedPreceding, 0)
    rest = Window.partitionBy("case").orderBy("k").rowsBetween(1, Window.unboundedFollowing)
    n0, n1 = F.sum("n").over(so_far), F.sum("n").over(rest)
    m0, m1 = F.sum(F.col("n") * F.col("c")).over(so_far) / n0, F.sum(F.col("n") * F.col("c")).over(rest) / n1
    split = h.withColumn("between", n0.cast("double") * n1 * F.pow(m0 - m1, 2)).where("between IS NOT NULL")
    best = split.groupBy("case").agg(F.max_by("c", F.struct("between", -F.col("k"))).alias("threshold"))
    return df.select("case").distinct().join(best, "case", "left")


def foreground_mask(df: DataFrame, bins: int = 256, darker: bool = True) -> DataFrame:
    """1 where a voxel is on the dark (or bright) side of its case's threshold, else 0."""
    t = F.col("threshold")
    return changed(df.join(otsu_thresholds(df, bins), "case"), F.when(F.col(V) < t if darker else F.col(V) > t, 1.0).otherwise(0.0)).drop("threshold")


def remapped(df: DataFrame, points: Sequence[tuple[float, float]]) -> DataFrame:
    """Values by a line through control points (from, to) in rising order, level beyond the first and last."""
    v, out = F.col(V), F.lit(float(points[-1][1]))
    for (x0, y0), (x1, y1) in list(zip(points[:-1], points[1:], strict=True))[::-1]:
        out = F.when(v < x1, y0 + (v - x0) / (x1 - x0) * (y1 - y0)).otherwise(out)
    return changed(df, F.when(v <= points[0][0], float(points[0][1])).otherwise(out))


def with_coordinates(df: DataFrame, shape: Sequence[int]) -> DataFrame:
    """Adds ``c_`` columns: each place from -0.5 to 0.5 along its axis."""
    return df.withColumns({f"c_{a}": F.col(a) / max(n - 1, 1) - 0.5 for a, n in zip(AXES, shape, strict=True)})


def bias_field(df: DataFrame, shape: Sequence[int], coefficients: Sequence[float]) -> DataFrame:
    """Times exp of a linear field over each axis scaled to [-1, 1]."""
    field = sum((c * (2 * F.col(a) / max(n - 1, 1) - 1) for c, a, n in zip(coefficients, AXES, shape, strict=True)), F.lit(0.0))
    return changed(df, F.col(V) * F.exp(field))


# -- places ----------------------------------------------------------------------


def flip(df: DataFrame, shape: Sequence[int], axes: Sequence[int]) -> DataFrame:
    return df.withColumns({AXES[k]: F.lit(shape[k] - 1) - F.col(AXES[k]) for k in axes})


def rotate90(df: DataFrame, shape: Sequence[int], k: int = 1, axes: tuple[int, int] = (0, 1)) -> DataFrame:
    """As numpy.rot90: from the first axis towards the second."""
    a, b = (AXES[i] for i in axes)
    n, m = shape[axes[0]], shape[axes[1]]
    new = {0: (F.col(a), F.col(b)), 1: (m - 1 - F.col(b), F.col(a)), 2: (n - 1 - F.col(a), m - 1 - F.col(b)), 3: (F.col(b), n - 1 - F.col(a))}[k % 4]
    return df.withColumns({a: new[0], b: new[1]})


def transpose(df: DataFrame, order: Sequence[int]) -> DataFrame:
    return df.withColumns({AXES[i]: F.col(AXES[k]) for i, k in enumerate(order)})


def crop(df: DataFrame, start: Sequence[int], end: Sequence[int]) -> DataFrame:
    """Half-open box, moved to the origin."""
    for a, s, e in zip(AXES, start, end, strict=True):
        df = df.where((F.col(a) >= s) & (F.col(a) < e))
    return df.withColumns({a: F.col(a) - s for a, s in zip(AXES, start, strict=True)})


def centre_crop(df: DataFrame, shape: Sequence[int], size: Sequence[int]) -> DataFrame:
    start = [max(0, n // 2 - k // 2) for n, k in zip(shape, size, strict=True)]
    return crop(df, start, [min(n, s + k) for n, s, k in zip(shape, start, size, strict=True)])


def pad(df: DataFrame, before: Sequence[int]) -> DataFrame:
    """Room before each axis; new voxels are absent, that is 0."""
    return df.withColumns({a: F.col(a) + b for a, b in zip(AXES, before, strict=True)})


def symmetric_pad(shape: Sequence[int], size: Sequence[int]) -> list[tuple[int, int]]:
    return [(max(k - n, 0) // 2, max(k - n, 0) - max(k - n, 0) // 2) for n, k in zip(shape, size, strict=True)]


def divisible_size(shape: Sequence[int], k: int) -> list[int]:
    return [-(-n // k) * k for n in shape]


def pad_or_crop(df: DataFrame, shape: Sequence[int], size: Sequence[int]) -> DataFrame:
    before = [b for b, _ in symmetric_pad(shape, size)]
    grown = [max(n, k) for n, k in zip(shape, size, strict=True)]
    return centre_crop(pad(df, before), grown, size)


def foreground_box(df: DataFrame, by: Sequence[str] = ("case",), margin: int = 0) -> DataFrame:
    """Half-open bounds of each case's nonzero voxels."""
    own = df.where(F.col(V) != 0)
    return own.groupBy(*by).agg(*((F.min(a) - margin).alias(f"{a}0") for a in AXES), *((F.max(a) + 1 + margin).alias(f"{a}1") for a in AXES))


def crop_foreground(df: DataFrame, margin: int = 0) -> DataFrame:
    d = df.join(foreground_box(df, margin=margin), "case")
    for a in AXES:
        d = d.where((F.col(a) >= F.col(f"{a}0")) & (F.col(a) < F.col(f"{a}1")))
    return d.withColumns({a: F.col(a) - F.col(f"{a}0") for a in AXES}).drop(*(f"{a}{k}" for a in AXES for k in (0, 1)))


def zoom_nearest(df: DataFrame, shape: Sequence[int], size: Sequence[int]) -> DataFrame:
    """Nearest-neighbour resize: each voxel is dealt to the places that fall on it."""
    d = df
    for a, n, k in zip(AXES, shape, size, strict=True):
        first, last = F.ceil(F.col(a) * k / n), F.ceil((F.col(a) + 1) * k / n) - 1
        d = d.withColumn(a, F.explode(F.when(last >= first, F.sequence(first, last)).otherwise(F.array().cast("array<bigint>"))))
    return d


def block_mean(df: DataFrame, factor: int) -> DataFrame:
    return df.groupBy("case", *(F.floor(F.col(a) / factor).alias(a) for a in AXES)).agg(F.avg(V).alias(V))


def grid_split(df: DataFrame, shape: Sequence[int], parts: Sequence[int]) -> DataFrame:
    """Adds the number of each voxel's block, and makes places relative to it."""
    size = [n // p for n, p in zip(shape, parts, strict=True)]
    block = [F.least(F.floor(F.col(a) / s), F.lit(p - 1)) for a, s, p in zip(AXES, size, parts, strict=True)]
    number = (block[0] * parts[1] + block[1]) * parts[2] + block[2]
    return df.withColumns({"block": number, **{a: F.col(a) - b * s for a, b, s in zip(AXES, block, size, strict=True)}})


def dropout(df: DataFrame, shape: Sequence[int], size: Sequence[int], holes: int, seed: int, fill: float = 0.0) -> DataFrame:
    """Boxes of each case at places that a hash draws get one value."""
    hit = F.lit(False)
    for h in range(holes):
        inside = F.lit(True)
        for k, (a, n, s) in enumerate(zip(AXES, shape, size, strict=True)):
            start = F.floor(uniform(seed + 97 * h + k, "case") * max(n - s + 1, 1))
            inside = inside & (F.col(a) >= start) & (F.col(a) < start + s)
        hit = hit | inside
    return changed(df, F.when(hit, F.lit(fill)).otherwise(F.col(V)))


def random_crops(cases: DataFrame, shape: Sequence[int], size: Sequence[int], n: int, seed: int) -> DataFrame:
    """(case, sample, x0, y0, z0): starts of random boxes."""
    d = cases.select("case").withColumn("sample", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    return d.withColumns({f"{a}0": F.floor(uniform(seed + k, "case", "sample") * max(m - s + 1, 1)) for k, (a, m, s) in enumerate(zip(AXES, shape, size, strict=True))})


def label_centres(df: DataFrame, ratios: Mapping[int, float], n: int, seed: int) -> DataFrame:
    """(case, label, x, y, z): n centres per case, shared among labels, drawn by hash order; voxels of value v are label v."""
    total = sum(ratios.values())
    want = F.coalesce(*(F.when(F.col(V) == k, F.lit(round(n * r / total))) for k, r in ratios.items()), F.lit(0))
    w = Window.partitionBy("case", V).orderBy(uniform(seed, "case", *AXES), *AXES)
    return df.withColumn("__n", F.row_number().over(w)).where(F.col("__n") <= want).select("case", F.col(V).cast("int").alias("label"), *AXES)


# -- labels ----------------------------------------------------------------------


def label_mask(df: DataFrame, labels: Sequence[int]) -> DataFrame:
    return changed(df, F.col(V).isin(*labels).cast("double"))


def map_labels(df: DataFrame, table: Mapping[int, int]) -> DataFrame:
    return changed(df, F.coalesce(*(F.when(F.col(V) == a, F.lit(float(b))) for a, b in table.items()), F.col(V)))


def label_filter(df: DataFrame, labels: Sequence[int]) -> DataFrame:
    return changed(df, F.when(F.col(V).isin(*labels), F.col(V)).otherwise(0.0))


def class_indices(df: DataFrame, shape: Sequence[int]) -> DataFrame:
    """(case, value, index): flat places (last axis fastest) of each class."""
    return df.select("case", V, ((F.col("x") * shape[1] + F.col("y")) * shape[2] + F.col("z")).alias("index"))


def one_hot(df: DataFrame, classes: int) -> DataFrame:
    return df.select("*", *((F.col(V) == k).cast("int").alias(f"class_{k}") for k in range(classes)))


def multi_channel(df: DataFrame) -> DataFrame:
    """Channels core (1, 4), whole (1, 2, 4), enhancing (4) of the older label convention."""
    c = F.col(V)
    return df.withColumns({"tc": c.isin(1, 4), "wt": c.isin(1, 2, 4), "et": c == 4})


def largest_component(df: DataFrame, labels: Sequence[int], connectivity: int = 26) -> DataFrame:
    """Other components of these labels become 0."""
    chosen = components(df.where(F.col(V).isin(*labels)), ("case", V), connectivity)
    n = chosen.groupBy("case", V, "component").agg(F.count("*").alias("n"))
    best = n.groupBy("case", V).agg(F.max_by("component", F.struct(F.col("n"), -F.col("component"))).alias("__c"))
    lost = chosen.join(best, ["case", V]).where(F.col("component") != F.col("__c")).select("case", *AXES, F.lit(True).alias("__l"))
    return changed(df.join(lost, ["case", *AXES], "left"), F.when(F.col("__l"), 0.0).otherwise(F.col(V))).drop("__l")


def fill_holes(df: DataFrame, shape: Sequence[int]) -> DataFrame:
    """Background that the border can't reach becomes foreground; cases of one label. Per case, in a dense array."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        full = np.zeros([n + 2 for n in shape], bool)
        at = tuple(pdf[a].to_numpy(int) + 1 for a in AXES)
        full[at] = pdf[V].to_numpy() != 0
        out = np.zeros_like(full)
        out[0] = out[-1] = out[:, 0] = out[:, -1] = out[:, :, 0] = out[:, :, -1] = True
        while True:
            grown = out.copy()
            for k in range(3):
                for s in (-1, 1):
                    grown |= np.roll(out, s, axis=k)
            grown &= ~full
            if grown.sum() == out.sum():
                break
            out = grown
        new = np.argwhere(~out & ~full) - 1
        if not len(new):
            return pdf
        value = pdf.loc[pdf[V] != 0, V].iloc[0]
        more = pd.DataFrame({"case": pdf["case"].iloc[0], **{a: new[:, k] for k, a in enumerate(AXES)}, V: value})
        both = pd.concat([pdf[pdf[V] != 0], more], ignore_index=True)
        return both[list(pdf.columns)]

    return df.groupBy("case").applyInPandas(run, _schema(df))


def smooth_mean(df: DataFrame, radius: int = 1) -> DataFrame:
    """Mean of the cube around each voxel; absent neighbours are 0. Neighbours meet by a join on places."""
    r = F.sequence(F.lit(-radius), F.lit(radius))
    d = df.select("case", *AXES, V)
    for a in AXES:
        d = d.withColumn("__d", F.explode(r)).withColumn(a, F.col(a) + F.col("__d")).groupBy("case", *AXES).agg(F.sum(V).alias(V))
    sums = changed(d, F.col(V) / float((2 * radius + 1) ** 3))
    return df.drop(V).join(sums, ["case", *AXES])


def gradient(df: DataFrame, axis: str) -> DataFrame:
    """Central differences along an axis; absent neighbours are 0."""
    other = [a for a in AXES if a != axis]
    up = df.select("case", *other, (F.col(axis) - 1).alias(axis), F.col(V).alias("__u"))
    down = df.select("case", *other, (F.col(axis) + 1).alias(axis), F.col(V).alias("__d"))
    d = df.join(up, ["case", *AXES], "left").join(down, ["case", *AXES], "left")
    return changed(d, (F.coalesce("__u", F.lit(0.0)) - F.coalesce("__d", F.lit(0.0))) / 2).drop("__u", "__d")


def merged_patches(patches: DataFrame) -> DataFrame:
    """Overlapping patches (case, x0.., x.., value, weight) averaged back into volumes."""
    place = [(F.col(f"{a}0") + F.col(a)).alias(a) for a in AXES]
    return patches.groupBy("case", *place).agg((F.sum(F.col(V) * F.col("weight")) / F.sum("weight")).alias(V))


def importance(size: Sequence[int], sigma: float = 0.125) -> Column:
    """Gaussian weight of a voxel's place in its patch."""
    e = sum((((F.col(a) - (n - 1) / 2) / (sigma * n)) ** 2 for a, n in zip(AXES, size, strict=True)), F.lit(0.0))
    return F.greatest(F.exp(-0.5 * e), F.lit(1e-3))


# -- signals and arrays ----------------------------------------------------------


def signal_shift(c: Column, by: int) -> Column:
    """An array moved to the right by ``by`` places, the end coming first."""
    n = F.size(c)
    k = F.pmod(F.lit(by), n)
    return F.when(n == 0, c).otherwise(F.concat(F.slice(c, n - k + 1, k), F.slice(c, F.lit(1), n - k)))


def signal_fill(c: Column, value: float = 0.0) -> Column:
    return F.transform(c, lambda x: F.coalesce(F.nanvl(x, F.lit(None)), F.lit(value)))


def signal_smooth(c: Column, weights: Sequence[float]) -> Column:
    """Weighted sum of the places around each one; beyond the ends the end values go on."""
    r, n = len(weights) // 2, F.size(c)

    def at(i: Column) -> Column:
        return sum((w * F.element_at(c, F.least(F.greatest(i + k - r, F.lit(1)), n)) for k, w in enumerate(weights)), F.lit(0.0))

    return F.when(n == 0, c).otherwise(F.transform(F.sequence(F.lit(1), n), at))


def savitzky_golay(window: int, order: int) -> list[float]:
    """Weights of the middle value of a least-squares polynomial over an odd window."""
    x = np.arange(window) - window // 2
    return np.linalg.pinv(np.vander(x, order + 1, increasing=True))[0].tolist()


def signal_median(c: Column, radius: int) -> Column:
    n = F.size(c)

    def at(i: Column) -> Column:
        around = F.array_sort(F.transform(F.sequence(F.lit(-radius), F.lit(radius)), lambda k: F.element_at(c, F.least(F.greatest(i + k, F.lit(1)), n))))
        return F.element_at(around, radius + 1)

    return F.when(n == 0, c).otherwise(F.transform(F.sequence(F.lit(1), n), at))


def _once(c: Column, f: Callable[[Column], Column]) -> Column:
    """``f`` of an array that is computed once, however often ``f`` names it."""
    return F.element_at(F.transform(F.array(c), f), 1)


def signal_wave(c: Column, magnitude: float, frequency: float, square: bool = False, start: float = 0.0, share: float = 1.0) -> Column:
    """A sine (or square pulse) of some periods over the array's length added to it, over a ``share`` of the places from ``start`` on."""

    def added(own: Column) -> Column:
        n = F.size(own)

        def at(x: Column, i: Column) -> Column:
            wave = F.sin(2 * np.pi * frequency * i / n)
            wave = F.when(wave > 0, 1.0).when(wave < 0, -1.0).otherwise(0.0) if square else wave
            first = F.floor(start * n)
            return x + F.when((i >= first) & (i < first + F.ceil(share * n)), wave * magnitude).otherwise(0.0)

        return F.transform(own, at)

    return _once(c, added)


def signal_drop(c: Column, start: float, share: float) -> Column:
    """0 over a ``share`` of the places from ``start`` on, both as parts of the length."""

    def dropped(own: Column) -> Column:
        first = F.floor(start * F.size(own))
        return F.transform(own, lambda x, i: F.when((i >= first) & (i < first + F.ceil(share * F.size(own))), 0.0).otherwise(x))

    return _once(c, dropped)


def mix(a: Column, b: Column, share: float) -> Column:
    return F.zip_with(a, b, lambda x, y: share * x + (1 - share) * y)


def cut_mix(a: Column, b: Column, start: int, end: int) -> Column:
    """Places start to end - 1 (from 0) of ``b`` put into ``a``."""
    return F.concat(F.slice(a, 1, start), F.slice(b, start + 1, end - start), F.slice(a, F.lit(end + 1), F.greatest(F.size(a) - end, F.lit(0))))


def composed(df: DataFrame, steps: Sequence[Callable[[DataFrame], DataFrame]], start: int = 0, end: int | None = None) -> DataFrame:
    """A chain of transforms; lists in it are flattened."""
    flat: list = []
    for s in steps:
        flat += s if isinstance(s, (list, tuple)) else [s]
    for f in flat[start:end]:
        df = df.transform(f)
    return df


def one_of(df: DataFrame, choices: Sequence[Column], weights: Sequence[float], seed: int, key: str) -> DataFrame:
    """Each row's value by one of several expressions, chosen by hash with given weights."""
    u, total, c, acc = uniform(seed, key), sum(weights), choices[-1], 0.0
    bounds = []
    for w in weights:
        acc += w / total
        bounds.append(acc)
    for expr, bound in list(zip(choices, bounds, strict=True))[-2::-1]:
        c = F.when(u < bound, expr).otherwise(c)
    return df.withColumn(V, c)
