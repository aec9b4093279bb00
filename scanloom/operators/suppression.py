"""Non-maximum suppression without a group in one task.

A box stays if no better box that stays overlaps it by more than the bar; better is the
higher score, then the smaller id. Boxes go to grid cells whose sizes follow from their
own extents: an IoU above the bar bounds the ratio of two boxes' extents on each axis, so
each axis has levels of cells and a box stands on its own level and the next. A round
takes, in each cell, the best box that is undecided; one that is the best of all its
cells stays, and what it overlaps goes. Rounds are repeated until none is undecided.
A cell's best is a partial aggregate and no more than one box per cell stays in a round,
so no pairs of a group are made and a hot group is spread over its cells.

Rounds write and shuffle every undecided box several times, so they are for groups of
more boxes than a list or a batch may hold. The others come together once and are gone
through from the best down.

Defined results: null scores are lowest; boxes without an extent, or with null
or non-finite edges, overlap nothing and stay; equal boxes of one id are decided one
after another in the order of their edges; an empty table gives no rows; further columns are kept.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scanloom.sources.shared import written

from .groups import by_whole_groups

#: Boxes of a group that come together as a list, voxels of a case that come together in a batch; larger ones go by rounds.
LISTED, BATCHED = 256, 1 << 14


def _split(rows: DataFrame, key: str, most: int) -> tuple[DataFrame, DataFrame | None]:
    """The rows of groups of at most ``most`` rows, and of the larger ones, if there are any."""
    large = written(rows.groupBy(F.col(key).alias("__large")).agg(F.count("*").alias("n")).where(F.col("n") > most).select("__large"))
    if large.isEmpty():
        return rows, None
    of_large = F.col(key).eqNullSafe(F.col("__large"))
    return rows.join(large, of_large, "left_anti"), rows.join(large, of_large, "left_semi")


def _cells(boxes: DataFrame, dims: Sequence[str], ratio: float) -> DataFrame:
    """A row per box and cell: on each axis the cells of its level and of the next that it touches."""
    for d in dims:
        low, high = F.col(f"__{d}0"), F.col(f"__{d}1")
        level = F.floor(F.ln(high - low) / math.log(ratio))

        def touched(up: int, low=low, high=high, level=level) -> Column:
            size = F.pow(F.lit(ratio), (level + up + 1).cast("double"))
            return F.transform(F.sequence(F.floor(low / size), F.floor(high / size)), lambda c: F.struct((level + up).alias("level"), c.alias("cell")))

        boxes = boxes.withColumn(f"__c{d}", F.explode(F.concat(touched(0), touched(1))))
    return boxes


def _score(score: Column) -> Column:
    return F.coalesce(F.nanvl(score.cast("double"), F.lit(None)), F.lit(float("-inf")))


def _in_lists(rows: DataFrame, group: str, bar: float, dims: Sequence[str]) -> DataFrame:
    """The boxes that stay, each group of sized boxes as a list."""
    row = F.struct(*(F.col(c).alias(f"c{i}") for i, c in enumerate(rows.columns)))
    at = {c: f"c{i}" for i, c in enumerate(rows.columns)}
    edges = [f"{d}{k}" for d in dims for k in (0, 1)]
    lists = rows.repartition(group).groupBy(group).agg(F.collect_list(row).alias("all"))
    ranked = F.array_sort(F.transform("all", lambda r, i: F.struct((-_score(r[at["score"]])).alias("s"), r[at["box_id"]].alias("box"), *(r[at[e]].cast("double").alias(f"e{n}") for n, e in enumerate(edges)), i.alias("i"))))

    def product_of(parts: list[Column]) -> Column:
        return reduce(Column.__mul__, parts)

    def overlaps(a: Column, b: Column) -> Column:
        ends = range(0, len(edges), 2)
        inter = product_of([F.greatest(F.lit(0.0), F.least(a[f"e{n + 1}"], b[f"e{n + 1}"]) - F.greatest(a[f"e{n}"], b[f"e{n}"])) for n in ends])
        size, other = (product_of([x[f"e{n + 1}"] - x[f"e{n}"] for n in ends]) for x in (a, b))
        return inter / F.greatest(size + other - inter, F.lit(1e-12)) > bar

    lists = lists.select("all", ranked.alias("ranked"))
    kind = lists.schema["ranked"].dataType
    kept = F.aggregate("ranked", F.array().cast(kind), lambda kept, b: F.when(F.exists(kept, lambda k: overlaps(b, k)), kept).otherwise(F.concat(kept, F.array(b))))
    stay = lists.select(F.inline(F.transform(kept, lambda k: F.element_at("all", k["i"] + 1))))
    return stay.select(*(F.col(at[c]).alias(c) for c in rows.columns))


def suppressed(boxes: DataFrame, group: str, bar: float, dims: Sequence[str] = ("x", "y"), listed: int = LISTED) -> DataFrame:
    """Boxes (``{d}0``, ``{d}1``, score, box_id) that stay in their group. The bar is above 0 and below 1."""
    if not 0 < bar < 1:
        raise ValueError("the bar is an IoU above 0 and below 1")
    sized = reduce(Column.__and__, [F.coalesce((F.col(f"{d}1") > F.col(f"{d}0")) & (F.col(f"{d}1") < float("inf")) & (F.col(f"{d}0") > float("-inf")), F.lit(False)) for d in dims])
    few, many = _split(boxes.where(sized), group, listed)
    stay = _in_lists(few, group, bar, dims).unionByName(boxes.where(~sized))
    return stay if many is None else stay.unionByName(_in_rounds(many, group, bar, dims))


def _in_rounds(boxes: DataFrame, group: str, bar: float, dims: Sequence[str]) -> DataFrame:
    """The boxes that stay of sized boxes."""
    # One row in a group can't be told from an equal one but by a number of its own, given once and written.
    rows = written(boxes.withColumn("__id", F.monotonically_increasing_id()))
    edges = [f"{d}{k}" for d in dims for k in (0, 1)]
    small = rows.select(F.col(group).alias("__group"), "__id", *(F.col(e).cast("double").alias(f"__{e}") for e in edges), _score(F.col("score")).alias("__score"), F.col("box_id").alias("__box"))
    undecided = written(_cells(small, dims, (1 + 1e-9) / bar))
    cell = ["__group", *(f"__c{d}" for d in dims)]
    better = F.struct((-F.col("__score")).alias("s"), F.col("__box"), *(F.col(f"__{e}") for e in edges), F.col("__id"))
    stays = []
    while True:
        best = undecided.groupBy(*cell).agg(F.min(better).alias("b"))
        all_cells = undecided.groupBy("__id").agg(F.count("*").alias("n"))
        # What is the best of all its cells; one row per cell at most.
        won = best.groupBy(F.col("b.__id").alias("__id")).agg(F.count("*").alias("m")).join(all_cells, "__id").where("m = n").select("__id")
        won = written(won)
        if won.isEmpty():
            break
        stays.append(won)
        kept = undecided.join(won, "__id", "left_semi").select(*(F.col(c).alias(f"o{c}") for c in cell), F.col("__id").alias("o__id"), *(F.col(f"__{e}").alias(f"o__{e}") for e in edges))
        met = undecided.join(kept, reduce(Column.__and__, [F.col(c).eqNullSafe(F.col(f"o{c}")) for c in cell]))
        inter = reduce(Column.__mul__, [F.greatest(F.lit(0.0), F.least(f"__{d}1", f"o__{d}1") - F.greatest(f"__{d}0", f"o__{d}0")) for d in dims])
        size, other = (reduce(Column.__mul__, [F.col(f"{o}__{d}1") - F.col(f"{o}__{d}0") for d in dims]) for o in ("", "o"))
        gone = met.where(inter / F.greatest(size + other - inter, F.lit(1e-12)) > bar).select("__id").union(won).distinct()
        undecided = written(undecided.join(gone, "__id", "left_anti"))
    return (rows.join(reduce(DataFrame.union, stays), "__id", "left_semi") if stays else rows.limit(0)).drop("__id")


def _peaks(places: np.ndarray, values: np.ndarray, radius: int) -> np.ndarray:
    """Rows of the peaks of one case."""
    order = np.lexsort((*places.T[::-1], -values))
    p, alive, kept = places[order], np.ones(len(order), bool), []
    for i in range(len(order)):
        if alive[i]:
            kept.append(i)
            alive[i:] &= (np.abs(p[i:] - p[i]) > radius).any(axis=1)
    return order[kept]


def _in_batches(rows: DataFrame, radius: int, axes: Sequence[str]) -> DataFrame:
    own = rows.select("case", *axes, "value").dropna(subset=["case", *axes])

    def run(pdf: pd.DataFrame, number: np.ndarray) -> pd.DataFrame:
        places, values = pdf[list(axes)].to_numpy(), pdf["value"].to_numpy(float)
        starts = np.flatnonzero(np.r_[True, number[1:] != number[:-1]])
        kept = [a + _peaks(places[a:b], values[a:b], radius) for a, b in zip(starts, [*starts[1:], len(pdf)], strict=True)]
        return pdf.iloc[np.concatenate(kept)]

    return by_whole_groups(own, ["case"], run, ", ".join(f"`{n}` {t}" for n, t in own.dtypes))


def probability_peaks(maps: DataFrame, least: float, radius: int, axes: Sequence[str] = ("x", "y"), batched: int = BATCHED) -> DataFrame:
    """(case, place, value) of the peaks of probability maps: the highest voxel above ``least`` stays, those within ``radius`` of it on every axis go, and so on.

    Voxels are boxes about their place; two of them meet if they lie within the radius. Equal values go to the first place.
    """
    few, many = _split(written(maps.where(F.col("value") > least)), "case", batched)
    found = _in_batches(few, radius, axes)
    return found if many is None else found.unionByName(_peaks_in_rounds(many, radius, axes))


def _peaks_in_rounds(rows: DataFrame, radius: int, axes: Sequence[str]) -> DataFrame:
    half = radius + 1
    cells = rows
    for a in axes:
        # A voxel stands in the cells of its own neighbourhood, of one size, so that any two within the radius share one.
        cells = cells.withColumn(f"__c{a}", F.explode(F.array_distinct(F.array(F.floor(F.col(a) / half), F.floor((F.col(a) + radius) / half)))))
    undecided = written(cells.select("case", *axes, "value", *(f"__c{a}" for a in axes)))
    cell = ["case", *(f"__c{a}" for a in axes)]
    better = F.struct((-F.col("value")).alias("s"), *axes)
    found = []
    while True:
        best = undecided.groupBy(*cell).agg(F.min(better).alias("b"))
        n = undecided.groupBy("case", *axes).agg(F.count("*").alias("n"))
        won = written(best.groupBy("case", *(F.col(f"b.{a}").alias(a) for a in axes)).agg(F.count("*").alias("m"), (-F.min("b.s")).alias("value")).join(n, ["case", *axes]).where("m = n").select("case", *axes, "value"))
        if won.isEmpty():
            break
        found.append(won)
        kept = undecided.join(won.select("case", *axes), ["case", *axes], "left_semi").select(*cell, *(F.col(a).alias(f"o_{a}") for a in axes))
        close = reduce(Column.__and__, [F.abs(F.col(a) - F.col(f"o_{a}")) <= radius for a in axes])
        gone = undecided.join(kept, cell).where(close).select("case", *axes).distinct()
        undecided = written(undecided.join(gone, ["case", *axes], "left_anti"))
    return reduce(DataFrame.union, found) if found else rows.select("case", *axes, "value").limit(0)
