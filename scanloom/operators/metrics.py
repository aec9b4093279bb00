"""Reductions, confusion counts and their families, curves, image errors, ensembles."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scanloom.functions.scalars import guarded

from .joins import running_totals


def _number(c: Column | str) -> Column:
    return F.nanvl((F.col(c) if isinstance(c, str) else c).cast("double"), F.lit(None))


def quantile(c: Column | str, share: float, accuracy: int | None = None) -> Column:
    """An interpolated quantile; with an accuracy a sketch of bounded size, for groups of very many values."""
    return F.percentile(c, share) if accuracy is None else F.percentile_approx(c, share, accuracy)


# -- summaries -------------------------------------------------------------------


def describe(df: DataFrame, group: Sequence[str], value: str, percentiles: Sequence[float] = (0.5, 99.5), accuracy: int | None = None) -> DataFrame:
    """Mean, median, extremes, population deviation, percentiles and the number of values."""
    v = _number(value)
    return df.groupBy(*group).agg(
        F.avg(v).alias("mean"),
        quantile(v, 0.5, accuracy).alias("median"),
        F.min(v).alias("min"),
        F.max(v).alias("max"),
        F.stddev_pop(v).alias("std"),
        F.count(v).alias("notnans"),
        *(quantile(v, p / 100, accuracy).alias(f"p{str(p).replace('.', '_')}") for p in percentiles),
    )


def array_checks(df: DataFrame, group: Sequence[str], value: str) -> DataFrame:
    """Share of nonzero values, whether all are finite, whether all are about equal."""
    v = F.col(value).cast("double")
    ok = ~(F.isnan(v) | (F.abs(v) == float("inf")))
    return df.groupBy(*group).agg(
        F.avg((v != 0).cast("double")).alias("nonzero_ratio"),
        F.every(ok).alias("all_finite"),
        (F.abs(F.max(v) - F.min(v)) <= 1e-8 + 1e-5 * F.abs(F.min(v))).alias("is_constant"),
    )


def reduced(df: DataFrame, row: str, column: str, value: str, how: str) -> DataFrame:
    """Reductions of a (row, column) table without NaN; what has no value is 0.

    ``mean`` is the mean of the rows' means, not of all values.
    """
    v = _number(value)
    if how == "none":
        return df.select(row, column, value)
    if how in ("mean", "sum"):
        rows = df.groupBy(row).agg((F.avg if how == "mean" else F.sum)(v).alias("v"))
        return rows.agg(F.coalesce((F.avg if how == "mean" else F.sum)("v"), F.lit(0.0)).alias("value"))
    by = {"batch": column, "channel": row}[how.split("_")[1]]
    return df.groupBy(by).agg(F.coalesce((F.avg if how.startswith("mean") else F.sum)(v), F.lit(0.0)).alias("value"))


def two_level(df: DataFrame, case: str, value: str, stats: Mapping[str, Callable[[Column], Column]]) -> DataFrame:
    """Mean over cases of each case's statistics (medians and deviations are averaged too)."""
    v = _number(value)
    per_case = df.groupBy(case).agg(*(f(v).alias(k) for k, f in stats.items()))
    return per_case.agg(*(F.avg(k).alias(k) for k in stats))


def rms_weights(df: DataFrame, channel: str, value: str) -> DataFrame:
    """Root mean squares of the channels, scaled to sum 1 and rounded to six places."""
    rms = df.groupBy(channel).agg(F.sqrt(F.avg(F.col(value) * F.col(value))).alias("rms"))
    total = rms.agg(F.sum("rms").alias("total"))
    return rms.join(F.broadcast(total)).select(channel, F.round(F.col("rms") / F.col("total"), 6).alias("weight"))  # one row


def zero_filled(cases: DataFrame, counts: DataFrame, key: str, count: str) -> DataFrame:
    return cases.join(counts, key, "left").withColumn(count, F.coalesce(count, F.lit(0)))


# -- confusion -------------------------------------------------------------------


def confusion(df: DataFrame, group: Sequence[str], truth: Column, guess: Column, ignore: Column | None = None) -> DataFrame:
    d = df if ignore is None else df.where(~F.coalesce(ignore, F.lit(False)))
    return d.groupBy(*group).agg(
        F.count_if(truth & guess).alias("tp"), F.count_if(~truth & guess).alias("fp"), F.count_if(truth & ~guess).alias("fn"), F.count_if(~truth & ~guess).alias("tn")
    )


def confusion_metrics(tp: str = "tp", fp: str = "fp", fn: str = "fn", tn: str = "tn") -> dict[str, Column]:
    """Named scores of the four counts; null where the denominator is 0."""
    a, b, c, d = (F.col(x).cast("double") for x in (tp, fp, fn, tn))

    def div(x: Column, y: Column) -> Column:
        return F.when(y != 0, x / y)

    tpr, tnr, ppv, npv = div(a, a + c), div(d, b + d), div(a, a + b), div(d, c + d)
    fnr, fpr = div(c, a + c), div(b, b + d)
    pt = div(F.sqrt(tpr * (1 - tnr)) + tnr - 1, tpr + tnr - 1)
    return {
        "dice": div(2 * a, 2 * a + b + c),
        "jaccard": div(a, a + b + c),
        "tpr": tpr,
        "tnr": tnr,
        "ppv": ppv,
        "npv": npv,
        "fnr": fnr,
        "fpr": fpr,
        "fdr": div(b, a + b),
        "for": div(c, c + d),
        "pt": pt,
        "ts": div(a, a + c + b),
        "acc": div(a + d, a + b + c + d),
        "ba": (tpr + tnr) / 2,
        "f1": div(2 * a, 2 * a + b + c),
        "mcc": div(a * d - b * c, F.sqrt((a + b) * (a + c) * (d + b) * (d + c))),
        "fm": F.sqrt(ppv * tpr),
        "bm": tpr + tnr - 1,
        "mk": ppv + npv - 1,
    }


def f_beta(beta: float, tp: Column, fp: Column, fn: Column) -> Column:
    b = beta * beta
    return guarded((1 + b) * tp, (1 + b) * tp + b * fn + fp)


def smoothed_dice(df: DataFrame, group: Sequence[str], truth: str, guess: str, eps: float = 1e-5) -> DataFrame:
    t, p = F.col(truth).cast("double"), F.col(guess).cast("double")
    return df.groupBy(*group).agg(((2 * F.sum(t * p) + eps) / (F.sum(t) + F.sum(p) + eps)).alias("dice"))


def generalized_dice(df: DataFrame, case: str, label: str, truth: str, guess: str, weights: str = "square") -> DataFrame:
    """(case, dice) over all classes of each case, weighted by the inverse of a class's volume (simple), of its square (square), or alike (uniform).

    A class that the truth doesn't have gets the case's largest weight. Without any weighted volume the score is 1 if nothing was guessed, else 0.
    """
    t, p = F.col(truth).cast("double"), F.col(guess).cast("double")
    c = df.groupBy(case, label).agg(F.sum(t * p).alias("i"), F.sum(t).alias("t"), F.sum(p).alias("p"))
    w = {"simple": F.when(F.col("t") > 0, 1 / F.col("t")), "square": F.when(F.col("t") > 0, 1 / (F.col("t") * F.col("t"))), "uniform": F.lit(1.0)}[weights]
    c = c.withColumn("w", w)
    i, n = (F.sum(F.col(x) * F.col("w")) for x in ("i", "__n"))
    # Classes without a weight of their own are summed apart, and weighted by the largest one afterwards.
    c = c.withColumn("__n", F.col("t") + F.col("p"))
    free = F.col("w").isNull()
    g = c.groupBy(case).agg(F.coalesce(i, F.lit(0.0)).alias("i"), F.coalesce(n, F.lit(0.0)).alias("n"), F.sum(F.when(free, F.col("i")).otherwise(0.0)).alias("fi"), F.sum(F.when(free, F.col("__n")).otherwise(0.0)).alias("fn"), F.coalesce(F.max("w"), F.lit(0.0)).alias("top"), F.sum("p").alias("p"))
    low = F.col("n") + F.col("top") * F.col("fn")
    score = F.when(low != 0, 2 * (F.col("i") + F.col("top") * F.col("fi")) / low).when(F.col("p") == 0, 1.0).otherwise(0.0)
    return g.select(case, score.alias("dice"))


def region_means(df: DataFrame, region: str, value: str) -> DataFrame:
    """Mean of each region without NaN and null; null where nothing is left."""
    return df.groupBy(region).agg(F.avg(_number(value)).alias("mean"))


def best_of(df: DataFrame, group: Sequence[str], value: str) -> DataFrame:
    """Each group's largest value, NaN aside: the best of its configurations."""
    return df.groupBy(*group).agg(F.max(_number(value)).alias(value))


def foreground_mean(df: DataFrame, label: str, value: str, skip: Sequence[int] = (0, -1, 99)) -> DataFrame:
    """Plain mean over the other classes: NaN spreads."""
    return df.where(~F.col(label).isin(*skip)).agg(F.avg(value).alias("foreground_mean"))


# -- curves ----------------------------------------------------------------------


def roc_auc(df: DataFrame, group: Sequence[str], truth: Column, score: str) -> DataFrame:
    """Area under the ROC curve; tied scores share their credit; null with one class only.

    Scores are counted per value first, and ranges of a group's scores are summed apart.
    """
    by = df.groupBy(*group, score).agg(F.count_if(truth).alias("pos"), F.count_if(~truth).alias("neg"))
    part = running_totals(by, [score], ["neg"], group).withColumn("less", F.col("total_neg") - F.col("neg"))
    total = part.groupBy(*group).agg(F.sum(F.col("pos") * (F.col("less") + F.col("neg") / 2)).alias("won"), F.sum("pos").alias("p"), F.sum("neg").alias("n"))
    return total.select(*group, F.when((F.col("p") > 0) & (F.col("n") > 0), F.col("won") / (F.col("p") * F.col("n"))).alias("auc"))


def averaged_auc(df: DataFrame, label: str, truth: Column, score: str, average: str = "macro") -> DataFrame:
    """One ``auc`` of several classes: the classes' mean (macro), by their positives (weighted), or of all scores together (micro).

    Null if a class has no area; ``none`` gives the classes' own.
    """
    if average not in ("none", "macro", "weighted", "micro"):
        raise ValueError(f"unknown average {average}")
    own = df.select(F.col(label).alias("label"), truth.alias("truth"), F.col(score).alias("score"))
    if average == "micro":
        return roc_auc(own.withColumn("label", F.lit(0)), ["label"], F.col("truth"), "score").select("auc")
    areas = roc_auc(own, ["label"], F.col("truth"), "score")
    if average == "none":
        return areas.withColumnRenamed("label", label)
    weight = F.lit(1.0)
    if average == "weighted":
        positives = own.groupBy(F.col("label").alias("__l")).agg(F.count_if("truth").alias("__n"))
        areas, weight = areas.join(positives, F.col("label").eqNullSafe(F.col("__l"))), F.col("__n")
    return areas.agg(F.when(F.count_if(F.col("auc").isNull()) == 0, F.sum(F.col("auc") * weight) / F.sum(weight)).alias("auc"))


def trapezoid(df: DataFrame, group: Sequence[str], x: str, y: str, normalised: bool = True) -> DataFrame:
    """Area under a curve by the trapezoid rule, over the range of x if normalised."""
    w = Window.partitionBy(*group).orderBy(x)
    d = df.withColumn("__a", (F.col(x) - F.lag(x).over(w)) * (F.col(y) + F.lag(y).over(w)) / 2)
    out = d.groupBy(*group).agg(F.coalesce(F.sum("__a"), F.lit(0.0)).alias("area"), (F.max(x) - F.min(x)).alias("__r"))
    area = F.when(F.col("__r") > 0, F.col("area") / F.col("__r")) if normalised else F.col("area")
    return out.select(*group, area.alias("area"))


def froc(detections: DataFrame, images: int, targets: int, rates: Sequence[float] = (0.25, 0.5, 1, 2, 4, 8)) -> DataFrame:
    """(rate, sensitivity) at false positives per image, linearly interpolated; ``detections``: score, is_hit."""
    by = detections.groupBy("score").agg(F.count_if("is_hit").alias("hits"), F.count_if(~F.col("is_hit")).alias("misses"))
    so_far = running_totals(by, [F.desc("score")], ["hits", "misses"])
    curve = so_far.select((F.col("total_misses") / images).alias("fps"), (F.col("total_hits") / targets).alias("sens"))
    curve = curve.groupBy("fps").agg(F.max("sens").alias("sens"))
    # Two aggregates per asked rate, in one pass over the curve.
    asked = {f"r{i}": float(r) for i, r in enumerate(rates)}
    aggs = []
    for k, r in asked.items():
        low, high = F.when(F.col("fps") <= r, F.col("fps")), F.when(F.col("fps") > r, F.col("fps"))
        aggs += [F.max(low).alias(f"{k}_f0"), F.max_by("sens", low).alias(f"{k}_s0"), F.min(high).alias(f"{k}_f1"), F.min_by("sens", high).alias(f"{k}_s1")]
    one = curve.agg(*aggs)
    rows = []
    for k, r in asked.items():
        s0, f0 = F.coalesce(f"{k}_s0", F.lit(0.0)), F.coalesce(f"{k}_f0", F.lit(0.0))
        line = s0 + (F.col(f"{k}_s1") - s0) * (r - f0) / (F.col(f"{k}_f1") - f0)
        rows.append(F.struct(F.lit(r).alias("rate"), F.when(F.col(f"{k}_f1").isNull(), s0).otherwise(line).alias("sensitivity")))
    return one.select(F.inline(F.array(*rows)))


# -- image errors ----------------------------------------------------------------


def image_errors(df: DataFrame, group: Sequence[str], a: str, b: str, peak: float = 1.0) -> DataFrame:
    d = F.col(a).cast("double") - F.col(b).cast("double")
    out = df.groupBy(*group).agg(F.avg(d * d).alias("mse"), F.avg(F.abs(d)).alias("mae"))
    psnr = F.when(F.col("mse") == 0, F.lit(float("inf"))).otherwise(10 * F.log10(peak * peak / F.col("mse")))
    return out.withColumns({"rmse": F.sqrt("mse"), "psnr": psnr})


def global_ssim(df: DataFrame, group: Sequence[str], a: str, b: str, peak: float = 1.0) -> DataFrame:
    """Structural similarity of whole images, from their moments."""
    c1, c2 = (0.01 * peak) ** 2, (0.03 * peak) ** 2
    m = df.groupBy(*group).agg(
        F.avg(a).alias("ma"), F.avg(b).alias("mb"), F.var_pop(a).alias("va"), F.var_pop(b).alias("vb"), F.covar_pop(a, b).alias("cab")
    )
    top = (2 * F.col("ma") * F.col("mb") + c1) * (2 * F.col("cab") + c2)
    bottom = (F.col("ma") ** 2 + F.col("mb") ** 2 + c1) * (F.col("va") + F.col("vb") + c2)
    return m.select(*group, (top / bottom).alias("ssim"))


def mean_correlation(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Mean of the upper triangle of the correlation matrix."""
    pairs = [F.corr(a, b) for i, a in enumerate(columns) for b in columns[i + 1 :]]
    return df.agg((sum(pairs[1:], pairs[0]) / len(pairs)).alias("mean_correlation"))


# -- ensembles -------------------------------------------------------------------


def mean_ensemble(df: DataFrame, group: Sequence[str], value: str, weight: str | None = None) -> DataFrame:
    if weight is None:
        return df.groupBy(*group).agg(F.avg(value).alias("value"))
    ok = F.col(value).isNotNull() & ~F.isnan(value) & (F.abs(F.col(value)) != float("inf"))
    return df.where(ok).groupBy(*group).agg((F.sum(F.col(value) * F.col(weight)) / F.sum(weight)).alias("value"))


def vote(df: DataFrame, group: Sequence[str], label: str) -> DataFrame:
    """The most frequent label, the lowest on ties."""
    n = df.groupBy(*group, label).agg(F.count("*").alias("n"))
    return n.groupBy(*group).agg(F.max_by(label, F.struct(F.col("n"), -F.col(label))).alias("label"))


def combine_masks(df: DataFrame, group: Sequence[str], mask: Column, how: str) -> DataFrame:
    f = {"or": F.bool_or(mask), "and": F.bool_and(mask), "min2": F.count_if(mask) >= 2}[how]
    return df.groupBy(*group).agg(f.alias("mask"))


def max_pool(df: DataFrame, group: Sequence[str], axes: Sequence[str], value: str, size: int = 4) -> DataFrame:
    return df.groupBy(*group, *(F.floor(F.col(a) / size).alias(a) for a in axes)).agg(F.max(value).alias(value))


def bounding_box(df: DataFrame, group: Sequence[str], axes: Sequence[str]) -> DataFrame:
    """Half-open bounds and the centre, rounded half to even."""
    return df.groupBy(*group).agg(
        *(F.min(a).alias(f"{a}_min") for a in axes), *((F.max(a) + 1).alias(f"{a}_max") for a in axes), *(F.bround(F.avg(a)).cast("int").alias(f"{a}_mid") for a in axes)
    )
