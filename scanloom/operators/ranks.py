"""Exact quantiles over groups of any size, by rank selection.

A histogram of each group's range says in which bucket each wanted rank lies; that
bucket's own range is cut again, until a bucket holds one value. Each pass reads the
rows once and shuffles at most ``BUCKETS`` counts per open range and task, so no task
ever holds a group's values or distinct values. Even values need two or three passes;
an outlier costs one more, as a bucket's range is that of its own values.

Defined results: nulls and NaN are left out; a group without values has null
quantiles; infinities are values; groups may be null; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scanloom.sources.shared import written

#: Buckets that a range is cut into.
BUCKETS = 4096
#: Stand-ins for the infinities, so that ranges stay finite.
LARGEST = 1.7976931348623157e308


def _same(a: DataFrame, b: DataFrame, names: Sequence[str]) -> Column:
    return reduce(Column.__and__, [a[n].eqNullSafe(b[f"o_{n}"]) for n in names], F.lit(True))


def _selected(rows: DataFrame, keys: Sequence[str], open_: DataFrame) -> DataFrame:
    """(keys, rank, found, before) for ``open_`` (keys, rank, before, low, high): the value of each wanted rank, and how many are below it."""
    done = []
    while True:
        done.append(open_.where("low = high").select(*keys, "rank", F.col("low").alias("found"), "before"))
        open_ = open_.where("low < high")
        if open_.isEmpty():
            return reduce(DataFrame.unionByName, done)
        spans = open_.select(*(F.col(k).alias(f"o_{k}") for k in keys), "before", "low", "high").distinct()
        inside = rows.join(spans, _same(rows, spans, keys) & F.col("__v").between(F.col("low"), F.col("high")))
        share = (F.col("__v") / 2 - F.col("low") / 2) / (F.col("high") / 2 - F.col("low") / 2)
        bucket = F.least(F.floor(share * BUCKETS), F.lit(BUCKETS - 1))
        counts = inside.groupBy(*(f"o_{k}" for k in keys), "before", bucket.alias("bucket")).agg(F.count("*").alias("n"), F.min("__v").alias("new_low"), F.max("__v").alias("new_high"))
        # At most BUCKETS rows of a range meet in a window.
        upto = Window.partitionBy(*(f"o_{k}" for k in keys), "before").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
        counts = counts.withColumn("new_before", F.col("before") + F.coalesce(F.sum("n").over(upto), F.lit(0))).withColumnRenamed("before", "o_before")
        hit = _same(open_, counts, keys) & (F.col("before") == F.col("o_before")) & (F.col("rank") >= F.col("new_before")) & (F.col("rank") < F.col("new_before") + F.col("n"))
        open_ = written(open_.join(counts, hit).select(*keys, "rank", F.col("new_before").alias("before"), F.col("new_low").alias("low"), F.col("new_high").alias("high")))


def nth(df: DataFrame, value: str, rank: int) -> tuple[float, int]:
    """The value of a rank, counted from 0 in rising order of the finite values of a column, and how many are below it."""
    rows = df.select(F.col(value).cast("double").alias("__v"), F.lit(0).alias("__all")).where("__v IS NOT NULL")
    ends = rows.agg(F.min("__v"), F.max("__v"), F.count("*")).first()
    if not 0 <= rank < ends[2]:
        raise ValueError(f"there is no rank {rank} among {ends[2]} values")
    wanted = df.sparkSession.createDataFrame([(0, rank, 0, ends[0], ends[1])], "__all int, rank long, before long, low double, high double")
    row = _selected(rows, ["__all"], wanted).first()
    return row["found"], row["before"]


def quantiles(df: DataFrame, group: Sequence[str], value: str, shares: Sequence[float]) -> DataFrame:
    """(group, share, value): interpolated between the two nearest ranks, for every share of every group."""
    names = [f"__g{i}" for i in range(len(group))]
    v = F.nanvl(F.col(value).cast("double"), F.lit(None))
    v = F.when(v.isNotNull(), F.least(F.greatest(v, F.lit(-LARGEST)), F.lit(LARGEST)))
    rows = df.select(*(F.col(g).alias(n) for g, n in zip(group, names, strict=True)), v.alias("__v")).withColumn("__all", F.lit(0))
    keys = [*names, "__all"]
    groups = written(rows.groupBy(*keys).agg(F.count("__v").alias("n"), F.min("__v").alias("low"), F.max("__v").alias("high")))
    # The two ranks that a share falls between, counted from 0.
    wanted = groups.where("n > 0").select(*keys, "n", "low", "high", F.explode(F.array(*(F.lit(float(s)) for s in shares))).alias("share"))
    at = F.col("share") * (F.col("n") - 1)
    ranks = F.array_distinct(F.array(F.floor(at), F.ceil(at)))
    open_ = written(wanted.select(*keys, F.explode(ranks).alias("rank"), F.lit(0).cast("long").alias("before"), "low", "high").distinct())
    found = _selected(rows.where("__v IS NOT NULL"), keys, open_).drop("before")
    found = found.withColumn("found", F.when(F.col("found") == LARGEST, float("inf")).when(F.col("found") == -LARGEST, float("-inf")).otherwise(F.col("found")))
    asked = groups.select(*keys, "n", F.explode(F.array(*(F.lit(float(s)) for s in shares))).alias("share"))
    at = F.col("share") * (F.col("n") - 1)
    sides = found.select(*(F.col(k).alias(f"o_{k}") for k in keys), "rank", "found")
    between = (F.col("rank") == F.floor(at)) | (F.col("rank") == F.ceil(at))
    met = asked.join(sides, _same(asked, sides, keys) & between, "left")
    low, high = F.min("found"), F.max("found")
    part = F.first(at - F.floor(at))
    value_ = F.when(low == high, low).otherwise(low + (high - low) * part)
    out = met.groupBy(*keys, "share").agg(value_.alias("value"))
    return out.select(*(F.col(n).alias(g) for g, n in zip(group, names, strict=True)), "share", "value")


def quantile_table(df: DataFrame, group: Sequence[str], value: str, shares: Mapping[str, float]) -> DataFrame:
    """(group, a column per named share)."""
    q = quantiles(df, group, value, list(dict.fromkeys(shares.values())))
    # max: one row per share.
    return q.groupBy(*group).agg(*(F.max(F.when(F.col("share") == float(s), F.col("value"))).alias(name) for name, s in shares.items()))


# -- reports of volumes ----------------------------------------------------------

#: Fixed names of a report's percentiles.
PERCENTILES = {"percentile_00_5": 0.005, "percentile_10_0": 0.1, "percentile_90_0": 0.9, "percentile_99_5": 0.995}
#: How a statistic of the cases becomes one of the data set; others are averaged.
SUMMARY = {"max": F.max, "min": F.min}


def statistics(df: DataFrame, group: Sequence[str], value: str, more: Mapping[str, Column] | None = None) -> DataFrame:
    """(group, max, mean, median, min, stdev, percentiles) of the values; ``more`` adds aggregates or replaces those of a name."""
    v = F.nanvl(F.col(value).cast("double"), F.lit(None))
    own = {"max": F.max(v), "mean": F.avg(v), "min": F.min(v), "stdev": F.stddev_pop(v), **(more or {})}
    plain = df.groupBy(*group).agg(*(c.alias(k) for k, c in own.items()))
    shares = {k: s for k, s in {"median": 0.5, **PERCENTILES}.items() if k not in own}
    exact = quantile_table(df, group, value, shares).select(*(F.col(g).alias(f"o_{g}") for g in group), *shares)
    return plain.join(exact, _same(plain, exact, group)).drop(*(f"o_{g}" for g in group))


def image_report(df: DataFrame, value: str = "value", label: str = "label", case: str = "case", more: Mapping[str, Column] | None = None) -> DataFrame:
    """(case, part, label, voxels, share, statistics): of each image, of its foreground (labels above 0) and of each label.

    A case without foreground has the statistics of one 0 there. ``share`` is the part of the image's voxels.
    """
    is_part = F.array(
        F.struct(F.lit("image").alias("part"), F.lit(None).cast("long").alias("__label")),
        F.struct(F.when(F.col(label) > 0, "foreground").alias("part"), F.lit(None).cast("long").alias("__label")),
        F.struct(F.when(F.col(label).isNotNull(), "label").alias("part"), F.col(label).cast("long").alias("__label")),
    )
    rows = df.select(F.col(case).alias(case), F.col(value).alias(value), F.explode(is_part).alias("p")).select(case, value, "p.part", F.col("p.__label").alias("label")).where("part IS NOT NULL")
    empty = df.groupBy(case).agg(F.coalesce(F.max(label), F.lit(0)).alias("__top")).where("__top <= 0")
    rows = rows.unionByName(empty.select(case, F.lit(0.0).alias(value), F.lit("foreground").alias("part"), F.lit(None).cast("long").alias("label")))
    stats = statistics(rows, [case, "part", "label"], value, {"voxels": F.count(F.lit(1)), **(more or {})})
    images = stats.where("part = 'image'").select(F.col(case).alias("__case"), F.col("voxels").alias("__n"))
    return stats.join(images, stats[case].eqNullSafe(images["__case"])).withColumn("share", F.col("voxels") / F.col("__n")).drop("__case", "__n")


def report_summary(report: DataFrame, by: Sequence[str] = ("part", "label"), overrides: Mapping[str, object] | None = None) -> DataFrame:
    """One row per part: the largest maximum, the smallest minimum, the means of all else; ``overrides`` names other aggregates."""
    how = {**SUMMARY, **(overrides or {})}
    columns = [c for c, t in report.dtypes if c not in (*by, "case") and t in ("double", "bigint", "int", "float")]
    return report.groupBy(*by).agg(F.count(F.lit(1)).alias("cases"), *(how.get(c, F.avg)(c).alias(c) for c in columns))
