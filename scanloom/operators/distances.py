"""Distances between distributions and instance sets, and pluggable aggregates."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from itertools import combinations_with_replacement

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Aggregates by name; users add their own.
AGGREGATES: dict[str, Callable[[Column], Column]] = {
    "mean": F.avg,
    "median": F.median,
    "max": F.max,
    "min": F.min,
    "std": F.stddev_pop,
    "sum": F.sum,
    "count": F.count,
    "p05": lambda c: F.percentile(c, 0.005),
    "p10": lambda c: F.percentile(c, 0.10),
    "p90": lambda c: F.percentile(c, 0.90),
    "p995": lambda c: F.percentile(c, 0.995),
}


def summarised(df: DataFrame, by: Sequence[str], columns: Sequence[str], names: Sequence[str], more: Mapping[str, Callable[[Column], Column]] | None = None) -> DataFrame:
    """Named aggregates of columns, from the registry and from ``more``."""
    known = AGGREGATES | dict(more or {})
    return df.groupBy(*by).agg(*(known[n](F.col(c)).alias(f"{c}_{n}") for c in columns for n in names))


def moments(df: DataFrame, columns: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
    """Mean and sample covariance of feature columns; one row with d * d numbers reaches the driver."""
    means = [F.avg(c) for c in columns]
    pairs = list(combinations_with_replacement(range(len(columns)), 2))
    row = df.agg(*means, *(F.covar_samp(columns[i], columns[j]) for i, j in pairs)).first()
    d = len(columns)
    cov = np.zeros((d, d))
    for (i, j), v in zip(pairs, row[d:], strict=True):
        cov[i, j] = cov[j, i] = v
    return np.array(row[:d], float), cov


def frechet_distance(a: DataFrame, b: DataFrame, columns: Sequence[str]) -> float:
    """Between Gaussians fitted to two feature tables."""
    (m1, c1), (m2, c2) = moments(a, columns), moments(b, columns)
    w, v = np.linalg.eigh(c1)
    root = (v * np.sqrt(np.maximum(w, 0))) @ v.T
    cross = np.sqrt(np.maximum(np.linalg.eigvalsh(root @ c2 @ root), 0)).sum()
    return float(((m1 - m2) ** 2).sum() + np.trace(c1) + np.trace(c2) - 2 * cross)


def linear_mmd(a: DataFrame, b: DataFrame, columns: Sequence[str]) -> float:
    """Squared maximum mean discrepancy with a linear kernel: the distance of the means."""
    row_a, row_b = (d.agg(*(F.avg(c) for c in columns)).first() for d in (a, b))
    return float(((np.array(row_a, float) - np.array(row_b, float)) ** 2).sum())


def panoptic_quality(matches: DataFrame, n_pred: DataFrame, n_truth: DataFrame, by: Sequence[str]) -> DataFrame:
    """Segmentation, recognition and panoptic quality of matched instances (with ``iou``) and counts ``n`` per side."""
    m = matches.groupBy(*by).agg(F.count("*").alias("tp"), F.sum("iou").alias("s"))
    d = n_pred.withColumnRenamed("n", "np").join(n_truth.withColumnRenamed("n", "nt"), list(by), "full_outer").join(m, list(by), "left")
    tp, s = F.coalesce("tp", F.lit(0)), F.coalesce("s", F.lit(0.0))
    fp, fn = F.coalesce("np", F.lit(0)) - tp, F.coalesce("nt", F.lit(0)) - tp
    sq, rq = F.when(tp > 0, s / tp).otherwise(0.0), F.when(tp + fp + fn > 0, tp / (tp + fp / 2 + fn / 2)).otherwise(0.0)
    return d.select(*by, sq.alias("sq"), rq.alias("rq"), (sq * rq).alias("pq"))


def sample_variance(df: DataFrame, by: Sequence[str], value: str, threshold: float = 0.0) -> DataFrame:
    """Mean over places of the population variance over repeated predictions, above a threshold."""
    v = df.groupBy(*by, "place").agg(F.var_pop(value).alias("v"))
    return v.where(F.col("v") >= threshold).groupBy(*by).agg(F.avg("v").alias("variance"))
