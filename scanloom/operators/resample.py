"""Resampling of volumes kept as long rows (case, x, y, z, value) by affine maps.

A plan has a row per case: ``shape`` of the source, ``size`` of the target and the
``matrix`` (twelve numbers, row by row) that maps a target voxel to a place in the
source. Every target voxel is dealt to the eight source voxels around its place with
their weights, meets them by an equi-join on coordinates, and sums what it has met;
no volume is held anywhere. Voxel centres are the grid points. Axis permutations and
flips are column arithmetic and need no join.

Defined results: absent voxels and null values count as 0; a target voxel that meets
no voxel is absent, that is 0; cases without a plan fall away; repeated voxels add up.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scanloom.functions.scalars import hash_score

from .voxels import AXES, V

#: World axes by their letters: the axis and its direction.
WORLD = {"R": (0, 1), "L": (0, -1), "A": (1, 1), "P": (1, -1), "S": (2, 1), "I": (2, -1)}
PLAN = "case {case}, shape array<int>, size array<int>, matrix array<double>"


# -- plans -----------------------------------------------------------------------


def one_plan(cases: DataFrame, shape: Sequence[int], size: Sequence[int], matrix: np.ndarray) -> DataFrame:
    """The same plan for every case; ``matrix`` is 3 x 4 or 4 x 4."""
    flat = [float(v) for v in np.asarray(matrix, float)[:3].reshape(-1)]
    lists = {"shape": [int(n) for n in shape], "size": [int(n) for n in size], "matrix": flat}
    return cases.select("case").distinct().select("case", *(F.array(*map(F.lit, v)).alias(k) for k, v in lists.items()))


def zoom_matrix(shape: Sequence[int], size: Sequence[int], align_corners: bool = False) -> np.ndarray:
    """Resizing: the first and last voxels' outer edges meet, or with ``align_corners`` their centres."""
    n, k = np.asarray(shape, float), np.asarray(size, float)
    if align_corners:
        return np.c_[np.diag((n - 1) / np.maximum(k - 1, 1)), np.zeros(3)]
    return np.c_[np.diag(n / k), 0.5 * n / k - 0.5]


def rotation_matrix(shape: Sequence[int], size: Sequence[int], angle: float, axes: tuple[int, int] = (0, 1)) -> np.ndarray:
    """Rotation by an angle in the plane of two axes about the volumes' centres."""
    turn = np.eye(3)
    a, b = axes
    turn[a, a] = turn[b, b] = np.cos(angle)
    turn[a, b], turn[b, a] = -np.sin(angle), np.sin(angle)
    return np.c_[turn, (np.asarray(shape) - 1) / 2 - turn @ ((np.asarray(size) - 1) / 2)]


def spacing_of(affine: np.ndarray) -> np.ndarray:
    return np.sqrt((np.asarray(affine, float)[:3, :3] ** 2).sum(axis=0))


def respaced(shape: Sequence[int], affine: np.ndarray, spacing: Sequence[float]) -> tuple[np.ndarray, np.ndarray]:
    """(size, affine) of a grid of the same directions with another spacing; a spacing that isn't above 0 is kept.

    The grid begins at that corner of the old one which is lowest along all new axes, else it is centred.
    """
    affine = np.asarray(affine, float)
    wanted = np.where(np.asarray(spacing, float) > 0, spacing, spacing_of(affine))
    q, r = np.linalg.qr(affine[:3, :3])
    new = np.eye(4)
    new[:3, :3] = q * np.sign(np.diag(r)) * wanted
    corners = np.stack([c.reshape(-1) for c in np.meshgrid(*([0.0, n - 1.0] for n in shape), indexing="ij")])
    world = affine[:3, :3] @ corners + affine[:3, 3:]
    placed = np.linalg.solve(new[:3, :3], world)
    size = np.round(np.ptp(placed, axis=1) + 1).astype(int)
    lowest = np.flatnonzero((np.abs(placed - placed.min(axis=1, keepdims=True)) < 1e-4).all(axis=0))
    half = np.asarray(shape) / 2
    new[:3, 3] = world[:, lowest[0]] if len(lowest) else affine[:3, :3] @ half + affine[:3, 3] - new[:3, :3] @ (size / 2)
    return size, new


def spacing_plans(headers: DataFrame, spacing: Sequence[float]) -> DataFrame:
    """Plans for (case, shape, affine): each case to the same spacing, by the grid of ``respaced``. The affine has sixteen numbers."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            size, matrix = [], []
            for shape, flat in zip(part["shape"], part["affine"], strict=True):
                affine = np.asarray(flat, float).reshape(4, 4)
                k, new = respaced(shape, affine, spacing)
                size.append(k.tolist())
                matrix.append(np.linalg.solve(affine, new)[:3].reshape(-1).tolist())
            yield part[["case", "shape"]].assign(size=size, matrix=matrix)

    own = headers.where("case IS NOT NULL AND shape IS NOT NULL AND affine IS NOT NULL").select("case", F.col("shape").cast("array<int>"), F.col("affine").cast("array<double>"))
    return own.mapInPandas(run, PLAN.format(case=dict(headers.dtypes)["case"]))


def random_plans(cases: DataFrame, shape: Sequence[int], size: Sequence[int], seed: int, prob: float = 1.0, rotate: float = 0.0, zoom: tuple[float, float] = (1.0, 1.0), translate: Sequence[float] = (0.0, 0.0, 0.0), axes: tuple[int, int] = (0, 1)) -> DataFrame:
    """A plan for each case with a rotation, a zoom and a translation of its own, drawn by hash scores, on the share ``prob`` of the cases.

    The target's centre falls on the source's; angles are up to ``rotate`` either way in the
    plane of ``axes``, zooms between two factors, translations up to ``translate`` voxels either way.
    """

    def draw(k: int) -> Column:
        return hash_score(F.concat_ws("::", F.col("case").cast("string"), F.lit(str(k))), seed)

    on = draw(0) < prob
    angle = F.when(on, (2 * draw(1) - 1) * rotate).otherwise(0.0)
    scale = F.when(on, 1 / (zoom[0] + (zoom[1] - zoom[0]) * draw(2))).otherwise(1.0)
    moved = [F.when(on, (2 * draw(3 + i) - 1) * float(t)).otherwise(0.0) for i, t in enumerate(translate)]
    a, b = axes
    turn = {(a, a): F.cos("__a"), (b, b): F.cos("__a"), (a, b): -F.sin("__a"), (b, a): F.sin("__a")}
    own = cases.select("case").distinct().select("case", angle.alias("__a"), scale.alias("__s"), *(m.alias(f"__m{i}") for i, m in enumerate(moved)))
    flat = []
    for i in range(3):
        row = [turn.get((i, k), F.lit(1.0 if i == k else 0.0)) * F.col("__s") for k in range(3)]
        middle = sum((r * ((n - 1) / 2) for r, n in zip(row, size, strict=True)), F.lit(0.0))
        flat += [*row, F.lit((shape[i] - 1) / 2) - middle + F.col(f"__m{i}")]
    return own.select("case", *(F.array(*(F.lit(int(n)) for n in v)).alias(k) for k, v in (("shape", shape), ("size", size))), F.array(*flat).alias("matrix"))


# -- resampling ------------------------------------------------------------------


def _places(plan: DataFrame) -> DataFrame:
    """A row per target voxel (tx, ty, tz) with its place (sx, sy, sz); a large target is dealt out by its first axis."""
    t = [f"t{a}" for a in AXES]

    def along(i: int) -> Column:
        n = F.col("size")[i]
        return F.explode(F.when(n > 0, F.sequence(F.lit(0).cast("long"), (n - 1).cast("long"))))

    rows = plan.select("case", "shape", "size", "matrix", along(0).alias(t[0])).repartition("case", t[0])
    rows = rows.select("*", along(1).alias(t[1])).select("*", along(2).alias(t[2]))
    m = F.col("matrix")
    place = [sum((m[4 * i + k] * F.col(c) for k, c in enumerate(t)), F.lit(0.0)) + m[4 * i + 3] for i in range(3)]
    return rows.select("case", "shape", *t, *(p.alias(f"s{a}") for p, a in zip(place, AXES, strict=True)))


def resampled(df: DataFrame, plan: DataFrame, mode: str = "linear", padding: str = "border") -> DataFrame:
    """(case, x, y, z, value) on the plan's targets. ``mode``: linear or nearest (halves to even); ``padding`` beyond the source: border or zeros."""
    if mode not in ("linear", "nearest") or padding not in ("border", "zeros"):
        raise ValueError(f"unknown mode {mode} or padding {padding}")
    rows = _places(plan)
    for i, a in enumerate(AXES):
        s, last = F.round(f"s{a}", 9), F.col("shape")[i] - 1  # what a product of matrices leaves behind isn't a place between voxels
        s = F.least(F.greatest(s, F.lit(0.0)), last.cast("double")) if padding == "border" else s
        low = F.floor(s)
        near = F.array(F.struct(low.alias("at"), (1 - (s - low)).alias("w")), F.struct((low + 1).alias("at"), (s - low).alias("w")))
        if mode == "nearest":
            near = F.array(F.struct(F.rint(s).cast("long").alias("at"), F.lit(1.0).alias("w")))
        rows = rows.withColumn(f"c{a}", near)
    rows = rows.select("case", "tx", "ty", "tz", *(f"c{a}" for a in AXES))
    for a in AXES:
        rows = rows.withColumn(f"c{a}", F.explode(F.filter(f"c{a}", lambda c: c["w"] > 0)))
    weight = F.col("cx.w") * F.col("cy.w") * F.col("cz.w")
    corners = rows.select("case", "tx", "ty", "tz", *(F.col(f"c{a}.at").alias(a) for a in AXES), weight.alias("w"))
    values = df.select("case", *(F.col(a).cast("long").alias(a) for a in AXES), F.col(V).cast("double").alias(V))
    # Rows that are exploded are many more than Spark takes them for; neither side is small enough to broadcast.
    met = corners.hint("merge").join(values, ["case", *AXES]).groupBy("case", "tx", "ty", "tz").agg(F.sum(F.col("w") * F.coalesce(V, F.lit(0.0))).alias(V))
    return met.select("case", *(F.col(f"t{a}").alias(a) for a in AXES), V)


def _dealt(n: int, k: int, step: float, offset: float, mode: str) -> list[tuple[int, int, float]]:
    """(place, target, weight) along an axis: the voxels of the source that a target's value is made of, at most two."""
    out = []
    for t in range(k):
        s = min(max(round(step * t + offset, 9), 0.0), n - 1.0)
        low = math.floor(s)
        near = [(round(s), 1.0)] if mode == "nearest" else [(low, 1 - (s - low)), (low + 1, s - low)]
        out += [(int(p), t, w) for p, w in near if w > 0]
    return out


def resized(df: DataFrame, shape: Sequence[int], size: Sequence[int], mode: str = "linear", align_corners: bool = False) -> DataFrame:
    """The same as ``resampled`` by ``zoom_matrix``, whose axes are apart: each voxel goes to its targets by a small table per axis, and what a target gets is summed before it is shuffled."""
    if mode not in ("linear", "nearest"):
        raise ValueError(f"unknown mode {mode}")
    matrix = zoom_matrix(shape, size, align_corners)
    rows = df.where("case IS NOT NULL").select("case", *(F.col(a).cast("long").alias(a) for a in AXES), F.coalesce(F.col(V).cast("double"), F.lit(0.0)).alias(V))
    for i, a in enumerate(AXES):
        table = df.sparkSession.createDataFrame(_dealt(int(shape[i]), int(size[i]), float(matrix[i, i]), float(matrix[i, 3]), mode), f"{a} long, t{a} long, w{a} double")
        rows = rows.join(F.broadcast(table), a)
    total = F.sum(F.col("wx") * F.col("wy") * F.col("wz") * F.col(V)).alias(V)
    return rows.groupBy("case", *(F.col(f"t{a}").alias(a) for a in AXES)).agg(total)


def smooth_field(cases: DataFrame, coarse: Sequence[int], shape: Sequence[int], seed: int, low: float = 0.0, high: float = 1.0) -> DataFrame:
    """(case, x, y, z, value): numbers drawn on a coarse grid for each case and interpolated between its voxels."""
    grid = cases.select("case").distinct()
    for a, n in zip(AXES, coarse, strict=True):
        grid = grid.withColumn(a, F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long"))))
    drawn = hash_score(F.concat_ws("::", *(F.col(c).cast("string") for c in ("case", *AXES))), seed)
    return resized(grid.withColumn(V, low + (high - low) * drawn), coarse, shape, align_corners=True)


def field_adjusted(df: DataFrame, field: DataFrame) -> DataFrame:
    """Values times the field's, where it has one."""
    f = field.select("case", *AXES, F.col(V).alias("__f"))
    return df.join(f.hint("merge"), ["case", *AXES], "left").withColumn(V, F.col(V) * F.coalesce("__f", F.lit(1.0))).drop("__f")


# -- orientation -----------------------------------------------------------------


def orientation(affine: np.ndarray) -> list[tuple[int, int]]:
    """For each voxel axis the world axis that it runs along and its direction, each world axis once."""
    directions = np.asarray(affine, float)[:3, :3]
    scale = spacing_of(affine)
    u, _, v = np.linalg.svd(directions / np.where(scale > 0, scale, 1))
    left, out = u @ v, []
    for k in range(3):
        world = int(np.argmax(np.abs(left[:, k])))
        out.append((world, -1 if left[world, k] < 0 else 1))
        left[world] = 0
    return out


def axis_codes(affine: np.ndarray) -> str:
    letters = {place: letter for letter, place in WORLD.items()}
    return "".join(letters[o] for o in orientation(affine))


def reorientation(affine: np.ndarray, codes: str) -> tuple[list[int], list[bool]]:
    """(order, flips) that bring voxel axes to ``codes``: target axis i is source axis order[i], reversed if flips[i]."""
    if sorted(WORLD[c][0] for c in codes) != [0, 1, 2]:
        raise ValueError(f"{codes} doesn't name each axis once")
    own = orientation(affine)
    at = {world: (k, sign) for k, (world, sign) in enumerate(own)}
    order = [at[WORLD[c][0]][0] for c in codes]
    return order, [at[WORLD[c][0]][1] != WORLD[c][1] for c in codes]


def reoriented(df: DataFrame, shape: Sequence[int], order: Sequence[int], flips: Sequence[bool]) -> DataFrame:
    """Axes permuted and reversed; no shuffle."""
    moved = [F.lit(shape[k] - 1) - F.col(AXES[k]) if f else F.col(AXES[k]) for k, f in zip(order, flips, strict=True)]
    return df.withColumns(dict(zip(AXES, moved, strict=True)))


def reoriented_affine(affine: np.ndarray, shape: Sequence[int], order: Sequence[int], flips: Sequence[bool]) -> np.ndarray:
    """The affine of what ``reoriented`` returns."""
    back = np.zeros((4, 4))
    back[3, 3] = 1
    for i, (k, f) in enumerate(zip(order, flips, strict=True)):
        back[k, i] = -1 if f else 1
        back[k, 3] = shape[k] - 1 if f else 0
    return np.asarray(affine, float) @ back
