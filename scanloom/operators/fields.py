"""Distance fields over voxels kept as long rows (case, x, y, z).

The squared distance to the nearest of a set of places separates by axes: one pass an
axis, in which each line takes the lower envelope of the parabolas that stand on its
known places. Lines are dealt out over tasks and stream through an Arrow function in
batches of many lines of one width; so neither a case nor a pair of surfaces is held
whole, and the work grows with the boxes' voxels instead of all pairs of points.

Defined results: places that stand twice count once; a case without sites has no
nearest place, which is an infinite distance; null coordinates are left out.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scanloom.sources.shared import written

from .voxels import AXES, V

#: Numbers in a matrix of lines at a time.
CELLS = 1 << 21


def lower_envelopes(f: np.ndarray, step: float = 1.0) -> np.ndarray:
    """For each row of ``f`` the minimum over j of (step * (i - j)) ** 2 + f[j], at every i; infinite where all of the row is.

    The envelopes of all rows grow together, a place at a time.
    """
    rows, n = f.shape
    w = step * step
    site, edge = np.zeros((rows, n), np.int64), np.full((rows, n + 1), np.inf)
    edge[:, 0] = -np.inf
    top = np.full(rows, -1)
    for q in range(n):
        own = np.flatnonzero(np.isfinite(f[:, q]))
        while len(own):
            k = top[own]
            v = site[own, k]
            with np.errstate(divide="ignore", invalid="ignore"):
                meet = (f[own, q] + w * q * q - f[own, v] - w * v * v) / (2 * w * (q - v))
            hidden = (k >= 0) & (meet <= edge[own, k])
            top[own[hidden]] -= 1
            at, new = own[~hidden], k[~hidden] + 1
            site[at, new] = q
            edge[at, new] = np.where(new > 0, meet[~hidden], -np.inf)
            edge[at, new + 1] = np.inf
            top[at] = new
            own = own[hidden]
    out, at, every = np.full((rows, n), np.inf), np.zeros(rows, np.int64), np.arange(rows)
    some = top >= 0
    for q in range(n):
        while (behind := some & (edge[every, at + 1] < q)).any():
            at[behind] += 1
        v = site[every, at]
        out[some, q] = (w * (q - v) ** 2 + f[every, v])[some]
    return out


def _lines(keys: Sequence[str], axis: str, step: float):
    """Batches of rows sorted by line to rows for each place from ``low`` to ``high`` of each line."""

    def one(part: pd.DataFrame, line: np.ndarray) -> Iterator[pd.DataFrame]:
        starts = np.flatnonzero(np.r_[True, line[1:] != line[:-1]])
        place, d2 = part[axis].to_numpy(np.int64), part["d2"].to_numpy(float)
        low, high = part["low"].to_numpy(np.int64)[starts], part["high"].to_numpy(np.int64)[starts]
        first = np.minimum(low, np.minimum.reduceat(place, starts))
        width = np.maximum(high, np.maximum.reduceat(place, starts)) - first + 1
        ends = np.r_[starts[1:], len(part)]
        a = 0
        while a < len(starts):
            b = a + 1
            most = width[a]
            while b < len(starts) and max(most, width[b]) * (b + 1 - a) <= CELLS:
                most = max(most, width[b])
                b += 1
            rows = np.arange(starts[a], ends[b - 1])
            number = np.repeat(np.arange(b - a), ends[a:b] - starts[a:b])
            f = np.full((b - a, most), np.inf)
            np.minimum.at(f, (number, place[rows] - first[a:b][number]), d2[rows])
            found = lower_envelopes(f, step)
            at = np.arange(most)[None] + first[a:b, None]
            row, column = np.nonzero((at >= low[a:b, None]) & (at <= high[a:b, None]) & np.isfinite(found))
            out = part.iloc[starts[a:b][row]][list(keys)].reset_index(drop=True)
            yield out.assign(**{axis: at[row, column], "d2": found[row, column]})
            a = b

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest = None
        for part in parts:
            part = part if rest is None else pd.concat([rest, part], ignore_index=True)
            line = part.groupby(list(keys), sort=False, dropna=False).ngroup().to_numpy()
            if not len(line):
                continue
            last = line == line[-1]  # its further rows may come with the next batch
            rest = part[last].reset_index(drop=True)
            if not last.all():
                yield from one(part[~last].reset_index(drop=True), line[~last])
        if rest is not None and len(rest):
            yield from one(rest, np.zeros(len(rest), np.int64))

    return run


def _pass(df: DataFrame, extents: DataFrame, axis: str, step: float, kind: str) -> DataFrame:
    keys = ["case", *(a for a in AXES if a != axis)]
    bounds = extents.select("case", F.col(f"{axis}_low").alias("low"), F.col(f"{axis}_high").alias("high"))
    rows = df.join(bounds, "case").repartition(*keys).sortWithinPartitions(*keys)
    schema = f"case {kind}, " + ", ".join(f"{a} long" for a in AXES) + ", d2 double"
    columns = ["case", *AXES, "d2"]
    return rows.select(*columns, "low", "high").mapInPandas(lambda parts: (p[columns] for p in _lines(keys, axis, step)(parts)), schema)


def _places(df: DataFrame) -> DataFrame:
    return df.select("case", *(F.col(a).cast("long").alias(a) for a in AXES)).dropna().distinct()


def nearest(points: DataFrame, sites: DataFrame, spacing: Sequence[float] = (1, 1, 1)) -> DataFrame:
    """(case, x, y, z, distance) of each point to the nearest site of its case, in units of ``spacing``; infinite without a site."""
    points, sites = written(_places(points)), _places(sites)
    kind = dict(points.dtypes)["case"]
    bounds = [f(a).alias(f"{a}_{end}") for a in AXES for f, end in ((F.min, "low"), (F.max, "high"))]
    extents = points.groupBy("case").agg(*bounds)
    field = sites.withColumn("d2", F.lit(0.0))
    for i, a in enumerate(AXES):
        if i == 2:  # only lines with a point are asked for
            field = field.join(points.select("case", "x", "y").distinct(), ["case", "x", "y"], "left_semi")
        field = _pass(field, extents, a, float(spacing[i]), kind)
    return points.join(field.hint("merge"), ["case", *AXES], "left").select("case", *AXES, F.coalesce(F.sqrt("d2"), F.lit(float("inf"))).alias("distance"))


def distance_transform(df: DataFrame, shape: Sequence[int], spacing: Sequence[float] = (1, 1, 1)) -> DataFrame:
    """(case, x, y, z, value): each nonzero voxel's distance to the nearest voxel of the box that is 0 or absent."""
    inside = [F.col(a).between(0, n - 1) for a, n in zip(AXES, shape, strict=True)]
    own = written(_places(df.where(F.col(V) != 0)).where(reduce(Column.__and__, inside)))
    grid = own.select("case").distinct()
    for k, (a, n) in enumerate(zip(AXES, shape, strict=True)):
        grid = grid.withColumn(a, F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long"))))
        grid = grid.repartition("case", a) if k == 0 else grid
    return nearest(own, grid.join(own.hint("merge"), ["case", *AXES], "left_anti"), spacing).withColumnRenamed("distance", V)


def surface_metrics(pred: DataFrame, truth: DataFrame, case: str = "case", spacing: Sequence[float] = (1, 1, 1), tolerance: float = 1.0) -> DataFrame:
    """(case, hd, hd95, asd, nsd) between boundaries given as voxels.

    A case that one side doesn't have is infinitely far, with an nsd of 0. The percentile is
    taken over a case's distinct distances, of which a box has few.
    """
    p, t = (written(_places(d.withColumnRenamed(case, "case"))) for d in (pred, truth))
    sides = []
    for name, a, b in (("p", p, t), ("t", t, p)):
        d = F.col("distance")
        sides.append(
            nearest(a, b, spacing).groupBy("case").agg(
                F.max(d).alias(f"{name}_max"), F.percentile(d, 0.95).alias(f"{name}_95"), F.avg(d).alias(f"{name}_mean"), F.count_if(d <= tolerance).alias(f"{name}_close"), F.count(d).alias(f"{name}_n")
            )
        )
    both = sides[0].join(sides[1], "case", "full_outer")
    ok = F.col("p_n").isNotNull() & F.col("t_n").isNotNull()

    def of(value: Column) -> Column:
        return F.when(ok, value).otherwise(F.lit(float("inf")))

    return both.select(
        F.col("case").alias(case),
        of(F.greatest("p_max", "t_max")).alias("hd"),
        of(F.greatest("p_95", "t_95")).alias("hd95"),
        of((F.col("p_mean") + F.col("t_mean")) / 2).alias("asd"),
        F.when(ok, (F.col("p_close") + F.col("t_close")) / (F.col("p_n") + F.col("t_n"))).otherwise(0.0).alias("nsd"),
    )


# -- maps about instances --------------------------------------------------------


def instance_maps(parts: DataFrame, group: Sequence[str] = ("case",)) -> DataFrame:
    """Adds ``h`` and ``v``: each voxel's offset in x and y from its component's rounded centre, from -1 to 1 on either side.

    A side's offsets are divided by the largest one on that side; one that is 0 stays 0.
    """
    keys = [*group, "component"]
    centre = parts.groupBy(*keys).agg(*(F.bround(F.avg(a)).alias(f"{a}_mid") for a in "xy"))
    d = parts.join(centre, keys).withColumns({f"{a}_off": F.col(a) - F.col(f"{a}_mid") for a in "xy"}).drop("x_mid", "y_mid")
    ends = d.groupBy(*keys).agg(*(f(f"{a}_off").alias(f"{a}_{end}") for a in "xy" for f, end in ((F.min, "least"), (F.max, "most"))))
    d = d.join(ends, keys)

    def scaled(a: str) -> Column:
        off, least, most = (F.col(f"{a}_{c}") for c in ("off", "least", "most"))
        return F.when(off < 0, off / -least).when(off > 0, off / most).otherwise(0.0)

    return d.withColumns({"h": scaled("x"), "v": scaled("y")}).drop(*(f"{a}_{c}" for a in "xy" for c in ("off", "least", "most")))


def extreme_points(df: DataFrame, group: Sequence[str] = ("case",), axes: Sequence[str] = AXES) -> DataFrame:
    """(group, point, x, y, z): for each axis the first voxel in the order of places that lies lowest, and the first that lies highest."""
    ends = []
    for a in axes:
        others = [F.col(b) for b in axes]
        ends += [(f"{a}_low", F.min(F.struct(F.col(a).alias("end"), *others))), (f"{a}_high", F.min(F.struct((-F.col(a)).alias("end"), *others)))]
    one = df.groupBy(*group).agg(*(c.alias(name) for name, c in ends))
    rows = F.array(*(F.struct(F.lit(name).alias("point"), *(F.col(f"{name}.{a}").alias(a) for a in axes)) for name, _ in ends))
    return one.select(*group, F.inline(rows))
