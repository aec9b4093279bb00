"""Lesion-wise metric aggregation: nested documents to penalised wide tables.

One row per (subject, region, lesion) and the false positives per (subject,
region) go in; a single grouping gives all columns. Each false positive counts
as a lesion of score 0 and distance 373; that enters in closed form, so no rows
are made for it.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scanloom.functions.scalars import HD95_PENALTY, f1, finite

from .metrics import quantile

SCORES = ("dsc", "nsd", "hd95")


@dataclass(frozen=True)
class Preset:
    volume: float
    overlap: float
    #: Infinite or missing distances become the penalty, and missing overlaps 0; otherwise they are left out.
    fill_scores: bool = False
    fill_missing: bool = True


OFFICIAL = Preset(20.0, 0.1)
TEAM = Preset(27.0, 0.2, fill_scores=True, fill_missing=False)


def aggregate(lesions: DataFrame, false_positives: DataFrame, preset: Preset = OFFICIAL) -> DataFrame:
    """Per (subject, region): counts, means and population deviations.

    ``lesions``: subject, region, volume, is_matched, dsc, nsd, hd95;
    ``false_positives``: subject, region, fp (one row each, also without lesions).
    """
    large, matched, seen = F.col("volume") >= preset.volume, F.col("is_matched"), F.col("volume").isNotNull()
    dsc, nsd, hd = finite("dsc"), finite("nsd"), finite("hd95")
    if preset.fill_scores:
        dsc, nsd, hd = F.coalesce(dsc, F.lit(0.0)), F.coalesce(nsd, F.lit(0.0)), F.coalesce(hd, F.lit(HD95_PENALTY))
    hit = matched & F.coalesce(dsc >= preset.overlap, F.lit(False))
    scores = {"dsc": F.when(matched, dsc).otherwise(0.0), "nsd": F.when(matched, nsd).otherwise(0.0), "hd95": F.when(matched, hd).otherwise(HD95_PENALTY)}
    judged = large | ~matched | dsc.isNotNull()  # a small match without a score is left out
    aggs = [
        F.count_if(seen & large).alias("n_large"),
        F.count_if(seen & ~large & judged).alias("n_small"),
        F.count_if(seen & large & hit).alias("tp_large"),
        F.count_if(seen & large & ~hit).alias("fn_large"),
        F.count_if(seen & ~large & judged & hit).alias("tp_small"),
        F.count_if(seen & ~large & judged & ~hit).alias("fn_small"),
    ]
    for k, c in scores.items():
        own = F.when(seen & large, c)
        aggs += [F.count(own).alias(f"n_{k}"), F.sum(own).alias(f"s_{k}"), F.sum(own * own).alias(f"q_{k}")]
    got = lesions.groupBy("subject", "region").agg(*aggs)
    d = false_positives.join(got, ["subject", "region"], "left")
    d = d.withColumn("fp", F.coalesce("fp", F.lit(0)).cast("long"))
    for c in ("n_large", "n_small", "tp_large", "fn_large", "tp_small", "fn_small"):
        d = d.withColumn(c, F.coalesce(c, F.lit(0)))
    some_large, some_small = F.col("n_large") > 0, F.col("n_small") > 0
    out: list[Column] = [F.col("subject"), F.col("region")]
    for k in SCORES:
        pen = HD95_PENALTY if k == "hd95" else 0.0
        n = F.col(f"n_{k}") + F.col("fp")
        mean = (F.col(f"s_{k}") + F.col("fp") * pen) / F.nullif(n, F.lit(0))
        var = F.greatest(F.lit(0.0), (F.col(f"q_{k}") + F.col("fp") * pen * pen) / F.nullif(n, F.lit(0)) - mean * mean)
        if k == "hd95":
            mean, var = F.coalesce(mean, F.lit(HD95_PENALTY)), F.coalesce(var, F.lit(0.0))
        out += [F.when(some_large, mean).alias(f"lesionwise_{k}_mean"), F.when(some_large, F.sqrt(var)).alias(f"lesionwise_{k}_std")]
    tp, fn, fp = F.col("tp_large") + F.col("tp_small"), F.col("fn_large") + F.col("fn_small"), F.col("fp")
    out += [
        F.when(some_small, f1(F.col("tp_small"), fp, F.col("fn_small"))).alias("small_instance_f1"),
        *(F.when(some_small, c).alias(f"small_instance_{n}") for n, c in (("tp", F.col("tp_small")), ("fp", fp), ("fn", F.col("fn_small")))),
        f1(tp, fp, fn).alias("all_instance_f1"),
        tp.alias("all_instance_tp"),
        fp.alias("all_instance_fp"),
        fn.alias("all_instance_fn"),
    ]
    return d.select(*out)


def wide(per_region: DataFrame, regions: Sequence[str]) -> DataFrame:
    """One row per subject with columns ``metric_region``; the regions are given, so no pass looks for them."""
    metrics = [c for c in per_region.columns if c not in ("subject", "region")]
    picked = [F.max(F.when(F.col("region") == r, F.col(m))).alias(f"{m}_{r}") for m in metrics for r in regions]
    return per_region.groupBy("subject").agg(*picked)


def fill_missing(table: DataFrame, expected: DataFrame) -> DataFrame:
    """Rows for expected subjects that aren't there: distances 373, all else 0."""
    lost = expected.select("subject").distinct().join(table, "subject", "left_anti")
    kinds = dict(table.dtypes)
    filled = lost.select("subject", *(F.lit(HD95_PENALTY if "hd95" in c else 0).cast(kinds[c]).alias(c) for c in table.columns if c != "subject"))
    return table.unionByName(filled)


def with_summary(table: DataFrame, key: str = "subject", accuracy: int | None = None) -> DataFrame:
    """Three further rows: mean, sample deviation and median (a sketch with an accuracy) of every number, without null and NaN."""
    numbers = [c for c, t in table.dtypes if c != key and t in ("int", "bigint", "float", "double")]
    value = {c: F.nanvl(F.col(c).cast("double"), F.lit(None)) for c in numbers}
    one = table.agg(*(f(value[c]).alias(f"{n}:{c}") for n, f in (("mean", F.avg), ("std", F.stddev_samp), ("median", lambda c: quantile(c, 0.5, accuracy))) for c in numbers))
    rows = [one.select(F.lit(n).alias(key), *(F.col(f"`{n}:{c}`").alias(c) for c in numbers)) for n in ("mean", "std", "median")]
    body = table.select(key, *(F.col(c).cast("double").alias(c) for c in numbers))
    for r in rows:
        body = body.unionByName(r)
    return body


def lesion_rows(documents: DataFrame, text: str = "value") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(lesions, false positives, missing subjects) of metric documents given as JSON text.

    A subject's keys that hold objects are its regions, so they are read as a map.
    """
    shape = (
        "struct<metrics:array<map<string,string>>,missings:array<string>>"
    )
    region = "struct<fp:double,reference_instances:array<struct<volume:double,is_matched:boolean,sq_dsc:double,sq_nsd:double,sq_hd95:double>>>"
    options = {"allowNonNumericNumbers": "true"}
    doc = documents.select(F.from_json(text, shape, options).alias("d"))
    subjects = doc.select(F.explode("d.metrics").alias("m")).select(F.element_at("m", "subject_name").alias("subject"), F.explode("m").alias("region", "body"))
    parts = subjects.where(F.col("body").startswith("{")).select("subject", "region", F.from_json("body", region, options).alias("r"))
    fps = parts.select("subject", "region", F.coalesce(finite("r.fp"), F.lit(0.0)).cast("long").alias("fp"))
    rows = parts.select("subject", "region", F.explode("r.reference_instances").alias("x")).select(
        "subject",
        "region",
        F.col("x.volume").alias("volume"),
        F.coalesce("x.is_matched", F.lit(False)).alias("is_matched"),
        F.col("x.sq_dsc").alias("dsc"),
        F.col("x.sq_nsd").alias("nsd"),
        F.col("x.sq_hd95").alias("hd95"),
    )
    return rows, fps, doc.select(F.explode("d.missings").alias("subject"))


def leaderboard(documents: DataFrame, regions: Sequence[str], preset: Preset = OFFICIAL) -> DataFrame:
    """The whole table: per subject and region, wide, with missing subjects and the summary rows."""
    rows, fps, missing = lesion_rows(documents)
    table = wide(aggregate(rows, fps, preset), regions)
    if preset.fill_missing:
        table = fill_missing(table, missing)
    return with_summary(table)
