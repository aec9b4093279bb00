"""Crops and rows drawn at random, alike at any partitioning.

Draws are hash scores of seed, case and number. A weighted place is found by prefix
sums: ranges of a case's voxels are summed apart, so a large case isn't in one task, and
draws meet the interval that holds them in bins of equal weight, by an equi-join.

Defined results: null and negative weights count as 0; a case without weight draws each
place alike; empty tables give no rows; of equal places each is one of its own.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scanloom.functions.scalars import hash_score
from scanloom.sources.shared import written

from .joins import running_totals
from .voxels import AXES, V, changed, uniform

#: Bins of a case's total weight.
BINS = 1024


def _draws(cases: DataFrame, n: int, seed: int) -> DataFrame:
    """(case, sample, u): ``n`` numbers in [0, 1) for each case."""
    d = cases.select("case").distinct().withColumn("sample", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    return d.withColumn("u", hash_score(F.concat_ws("::", F.col("case").cast("string"), F.col("sample").cast("string")), seed))


def weighted_places(weights: DataFrame, n: int, seed: int, order: Sequence[str] = AXES, weight: str = "weight") -> DataFrame:
    """(case, sample, order...): for each draw the first place, in order, at which the weights so far exceed its share of the case's total."""
    w = F.coalesce(F.nanvl(F.greatest(F.col(weight).cast("double"), F.lit(0.0)), F.lit(0.0)), F.lit(0.0))
    rows = weights.select("case", *order, w.alias("w"))
    totals = rows.groupBy("case").agg(F.sum("w").alias("total"), F.count("*").alias("rows"))
    totals = totals.select(F.col("case").alias("__case"), F.col("total").alias("__total"), "rows")
    rows = rows.join(totals, F.col("case").eqNullSafe(F.col("__case"))).withColumn("w", F.when(F.col("__total") > 0, F.col("w")).otherwise(1.0))
    rows = rows.withColumn("total", F.when(F.col("__total") > 0, F.col("__total")).otherwise(F.col("rows").cast("double"))).drop("__case", "__total", "rows")
    ends = written(running_totals(rows.where("w > 0"), list(order), ["w"], ["case"]))
    low, width = F.col("total_w") - F.col("w"), F.col("total") / BINS
    held = ends.select("case", *order, low.alias("low"), F.col("total_w").alias("high"), "total", F.explode(F.sequence(F.floor(low / width), F.least(F.floor(F.col("total_w") / width), F.lit(BINS).cast("long")))).alias("bin"))
    draws = _draws(ends, n, seed).join(ends.groupBy(F.col("case").alias("__case")).agg(F.first("total").alias("total")), F.col("case").eqNullSafe(F.col("__case"))).select(F.col("case").alias("__case"), "sample", (F.col("u") * F.col("total")).alias("at"), F.floor(F.col("u") * F.col("total") / (F.col("total") / BINS)).alias("__bin"))
    hit = F.col("case").eqNullSafe(F.col("__case")) & (F.col("bin") == F.col("__bin")) & (F.col("at") >= F.col("low")) & (F.col("at") < F.col("high"))
    return draws.join(held, hit).select("case", "sample", *order)


def weighted_crops(weights: DataFrame, shape: Sequence[int], size: Sequence[int], n: int, seed: int) -> DataFrame:
    """(case, sample, x0, y0, z0): starts of boxes of ``size`` whose centres are drawn by the weights of the voxels about which a box fits; the last start of an axis is left out unless it is the only one."""
    own = weights
    for a, m, k in zip(AXES, shape, size, strict=True):
        own = own.where((F.col(a) >= k // 2) & (F.col(a) < m - k + k // 2) if m > k else F.col(a) == m // 2)
    at = weighted_places(own, n, seed)
    return at.select("case", "sample", *((F.col(a) - min(m, k) // 2).alias(f"{a}0") for a, m, k in zip(AXES, shape, size, strict=True)))


def random_rows(df: DataFrame, key: str, share: float, seed: int) -> DataFrame:
    """For about ``share`` of the cases one of its rows, each as likely: by a draw of the case, and the row of the smallest draw of its own."""
    chosen = hash_score(F.concat_ws("::", F.lit("case"), F.col("case").cast("string")), seed) < share
    own = hash_score(F.concat_ws("::", F.col("case").cast("string"), F.col(key).cast("string")), seed)
    rest = [c for c in df.columns if c != "case"]
    return df.where(chosen).groupBy("case").agg(F.min_by(F.struct(*rest), F.struct(own, F.col(key))).alias("r")).select("case", "r.*")


def randomly(df: DataFrame, prob: float, seed: int, value: Callable[[Column], Column], low: float = 0.0, high: float = 1.0) -> DataFrame:
    """An intensity transform with a coefficient between ``low`` and ``high`` drawn for each case, on the share ``prob`` of the cases.

    ``value`` makes the new value of the coefficient; with it every plain intensity transform has its random twin.
    """
    on = uniform(seed, "case") < prob
    return changed(df, F.when(on, value(F.lit(low) + (high - low) * uniform(seed + 1, "case"))).otherwise(F.col(V)))


def randomly_placed(df: DataFrame, prob: float, seed: int, places: Sequence[dict[str, Column]]) -> DataFrame:
    """One of several moves of the coordinates drawn for each case (flips of an axis, quarter turns), on the share ``prob`` of the cases."""
    on, which = uniform(seed, "case") < prob, F.floor(uniform(seed + 1, "case") * len(places))
    new = {}
    for a in AXES:
        c = F.col(a)
        for i, place in enumerate(places):
            if a in place:
                c = F.when(on & (which == i), place[a]).otherwise(c)
        new[a] = c
    return df.withColumns(new)
