"""Numbering, splits, rankings and series operators.

Global orders go through range partitions or hash ranks, not through one task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scanloom.functions.scalars import hash_score, padded

from .joins import numbered, numbered_within
from .ranks import nth


def surrogate_ids(df: DataFrame, order: Sequence[Column | str], prefix: str, name: str, width: int = 6, first: int = 1) -> DataFrame:
    out = numbered(df, order, "__row")
    return out.withColumn(name, padded(prefix, width, F.col("__row") + first)).drop("__row")


def hash_split(df: DataFrame, key: str, seed: int, share: float, held: str = "val", other: str = "train") -> DataFrame:
    """The round(n * share) ids of the smallest (score, id) are held out.

    Python's half-even rounding. The cut's score is found by rank selection, and of equal
    scores at the cut the smallest ids; so the split doesn't depend on partitions, and no
    row is sorted.
    """
    scored = df.withColumn("score", hash_score(key, seed))
    n = scored.count()
    take = int(scored.sparkSession.range(1).select(F.bround(F.lit(n * share)).alias("k")).first()["k"]) if n else 0
    if take <= 0 or take >= n:
        return scored.withColumn("split", F.lit(held if take else other))
    cut, below = nth(scored, "score", take - 1)
    if scored.where(F.col("score") == cut).count() == take - below:  # no tie goes through the cut
        return scored.withColumn("split", F.when(F.col("score") <= cut, held).otherwise(other))
    last = numbered(scored.where(F.col("score") == cut).select(key), [key], "__rank").where(F.col("__rank") < take - below).select(F.col(key).alias("__key"))
    marked = scored.join(last.distinct().withColumn("__last", F.lit(True)), (F.col("score") == cut) & (F.col(key) == F.col("__key")), "left")
    is_held = (F.col("score") < cut) | F.coalesce("__last", F.lit(False))
    return marked.withColumn("split", F.when(is_held, held).otherwise(other)).drop("__key", "__last")


def locked_split(df: DataFrame, legacy: DataFrame, key: str, seed: int, share: float) -> DataFrame:
    """Ids that an earlier split held out become the test set; the others are split by hash."""
    locked = legacy.where("legacy = 'val'").select(key).distinct()
    test = df.join(locked, key, "left_semi").select(*df.columns, F.lit("test").alias("split"))
    pool = df.join(locked, key, "left_anti").select(*df.columns)
    return test.unionByName(hash_split(pool, key, seed, share).select(*df.columns, "split"))


def k_fold(df: DataFrame, key: str, seed: int, k: int) -> DataFrame:
    """Folds of equal size by rank of the hash score."""
    scored = df.withColumn("score", hash_score(key, seed))
    ranks = numbered(scored.select(key, "score"), ["score", key], "__rank").select(key, (F.col("__rank") % k).cast("int").alias("fold"))
    return scored.join(ranks, key)


def ratio_parts(df: DataFrame, order: Sequence[str], ratios: Sequence[float]) -> DataFrame:
    """Consecutive parts; bounds are the cumulative shares of n, rounded half up."""
    n, total, bounds = df.count(), sum(ratios), []
    for i in range(len(ratios)):
        bounds.append(int(sum(ratios[: i + 1]) / total * n + 0.5))
    c = F.lit(len(ratios) - 1)
    for i in range(len(ratios) - 2, -1, -1):
        c = F.when(F.col("__row") < bounds[i], i).otherwise(c)
    return numbered(df, order).withColumn("part", c).drop("__row")


def stratified_parts(df: DataFrame, by: str, order: Sequence[str], ratios: Sequence[float]) -> DataFrame:
    """As above within each class; ranges of a class are numbered apart."""
    sizes = df.groupBy(F.col(by).alias("__by")).agg(F.count("*").alias("__n"))
    rows = numbered_within(df, [by], order, "__nth")
    rows = rows.join(sizes, F.col(by).eqNullSafe(F.col("__by")))
    total, c = sum(ratios), F.lit(len(ratios) - 1)
    for i in range(len(ratios) - 2, -1, -1):
        c = F.when(F.col("__nth") < F.floor(F.col("__n") * (sum(ratios[: i + 1]) / total) + 0.5), i).otherwise(c)
    return rows.withColumn("part", c).drop("__nth", "__by", "__n")


def prefer(df: DataFrame, key: str, good: Column, order: Sequence[Column | str]) -> DataFrame:
    """One row of each key: the first that is good, else the first."""
    w = Window.partitionBy(key).orderBy(F.coalesce(good, F.lit(False)).desc(), *order)
    return df.withColumn("__nth", F.row_number().over(w)).where("__nth = 1").drop("__nth")


def mean_rank(df: DataFrame, item: str, dataset: str, value: str) -> DataFrame:
    """Each item's ordinal rank by falling value in each dataset (from 0), averaged; ranges of a dataset are numbered apart."""
    return numbered_within(df, [dataset], [F.desc(value), item], "rank").groupBy(item).agg(F.avg("rank").alias("mean_rank"))


def best_key(df: DataFrame, key: str, score: str, order: str) -> DataFrame:
    """The key of the largest score; the first in order on ties."""
    return df.agg(F.max_by(key, F.struct(F.col(score), -F.col(order))).alias(key))


def latest(df: DataFrame, group: Sequence[str], name: str, prefix: str) -> DataFrame:
    """(group, latest): the last of the names with the prefix, in the order of text."""
    return df.where(F.col(name).startswith(prefix)).groupBy(*group).agg(F.max(name).alias("latest"))


def jitter(df: DataFrame, group: Sequence[str], order: Sequence[str], value: str) -> DataFrame:
    """Mean absolute difference of neighbours in each series."""
    w = Window.partitionBy(*group).orderBy(*order)
    return df.withColumn("__d", F.abs(F.col(value) - F.lag(value).over(w))).groupBy(*group).agg(F.avg("__d").alias("jitter"))


def trend(df: DataFrame, group: Sequence[str], order: Sequence[str], value: str, least: int = 10) -> DataFrame:
    """Means of the first and second half of series of at least ``least`` values, and their difference."""
    w, whole = Window.partitionBy(*group).orderBy(*order), Window.partitionBy(*group)
    d = df.withColumns({"__nth": F.row_number().over(w), "__n": F.count("*").over(whole)}).where(F.col("__n") >= least)
    early = F.col("__nth") <= F.floor(F.col("__n") / 2)
    out = d.groupBy(*group).agg(F.avg(F.when(early, F.col(value))).alias("first_half"), F.avg(F.when(~early, F.col(value))).alias("second_half"))
    return out.withColumn("change", F.col("second_half") - F.col("first_half"))


def series_summary(df: DataFrame, group: Sequence[str], step: str, value: str) -> DataFrame:
    return df.groupBy(*group).agg(
        F.min_by(value, step).alias("first"), F.max_by(value, step).alias("last"), F.min(value).alias("min"), F.max(value).alias("max"), F.avg(value).alias("mean")
    )


def best_so_far(df: DataFrame, group: Sequence[str], order: Sequence[str], value: str) -> DataFrame:
    """Flags rows whose value is above all before them."""
    before = Window.partitionBy(*group).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    top = F.max(value).over(before)
    return df.withColumn("is_best", top.isNull() | (F.col(value) > top))


def stopping_step(df: DataFrame, group: Sequence[str], step: str, value: str, patience: int) -> DataFrame:
    """The first step at which the last ``patience`` steps brought no new best."""
    w = Window.partitionBy(*group).orderBy(step)
    marked = best_so_far(df, group, [step], value).withColumn("__nth", F.row_number().over(w))
    last = F.max(F.when(F.col("is_best"), F.col("__nth"))).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return marked.withColumn("__gap", F.col("__nth") - last).where(F.col("__gap") >= patience).groupBy(*group).agg(F.min(step).alias("stop_step"))


def resampled(df: DataFrame, factor: float, order: Sequence[str]) -> DataFrame:
    """Every row floor(factor) times, and the first round(n * rest) rows once more."""
    whole, rest = int(factor), factor - int(factor)
    repeated = df.withColumn("__k", F.explode(F.sequence(F.lit(1), F.lit(whole)))).drop("__k") if whole else df.limit(0)
    if not rest:
        return repeated
    more = numbered(df, order).where(F.col("__row") < int(df.count() * rest + 0.5)).drop("__row")
    return repeated.unionByName(more)


def weighted_sample(df: DataFrame, key: str, weight: str, n: int, seed: int) -> DataFrame:
    """Without replacement, by exponential keys of the hash score (reproducible)."""
    u = F.greatest(hash_score(key, seed), F.lit(1e-18))
    return df.where(F.col(weight) > 0).orderBy(-F.ln(u) / F.col(weight), key).limit(n)


def cache_window(df: DataFrame, row: str, n: int, size: int, replace: int, epoch: int) -> DataFrame:
    """Rows that a sliding cache of ``size`` holds in an epoch that replaces ``replace`` rows each time."""
    return df.where(F.pmod(F.col(row) - epoch * replace, F.lit(n)) < size)
