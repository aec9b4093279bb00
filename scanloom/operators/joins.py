"""Joins: overlays, lookups, membership, theta and aligned joins.

Sides whose size nothing bounds are left to Catalyst and AQE; none is broadcast by a hint.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scanloom.sources.shared import shared_dir, written


def left_overlay(base: DataFrame, extra: DataFrame, key: str, suffix: str, fill: Sequence[str] = ()) -> DataFrame:
    """Left join; shared columns of ``extra`` get a suffix, those in ``fill`` fill the base's nulls and then go."""
    shared = {c for c in extra.columns if c != key and c in base.columns}
    named = extra.select(key, *(F.col(c).alias(c + suffix if c in shared else c) for c in extra.columns if c != key))
    out = base.join(named, key, "left")
    for c in fill:
        out = out.withColumn(c, F.coalesce(c + suffix, c)).drop(c + suffix)
    return out


def one_row(df: DataFrame, key: str) -> DataFrame:
    """One row of each key: the smallest in the order of the columns, so that a join to it adds no rows."""
    rest = [c for c in df.columns if c != key]
    if not rest:
        return df.distinct()
    return df.groupBy(key).agg(F.min(F.struct(*rest)).alias("__r")).select(key, "__r.*")


def lookups(base: DataFrame, tables: Sequence[tuple[DataFrame, str, str]]) -> DataFrame:
    """Left joins with several tables, each (table, its key, the base's key); a miss gives nulls, of a key's rows the smallest counts."""
    for table, own, theirs in tables:
        base = base.join(one_row(table.withColumnRenamed(own, theirs) if own != theirs else table, theirs), theirs, "left")
    return base


def fold_join(frames: Sequence[DataFrame], on: Sequence[str] | None = None, how: str = "inner") -> DataFrame:
    """Joins from left to right; by default on all columns that two sides share."""

    def step(a: DataFrame, b: DataFrame) -> DataFrame:
        keys = list(on) if on else [c for c in a.columns if c in b.columns]
        if not keys:
            raise ValueError("the tables share no column to join on")
        return a.join(b, keys, how)

    return reduce(step, frames)


def settled(df: DataFrame) -> DataFrame:
    """Checkpointed to the shared folder, so that partition numbers stay as they are."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared_dir(df.sparkSession))
    return df.checkpoint()


def numbered(df: DataFrame, order: Sequence[Column | str], name: str = "__row") -> DataFrame:
    """Rows counted from 0 in a total order, without bringing them to one task.

    Rows are range-partitioned by the order; each partition's count gives the next one's start.
    """
    parts = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__part", F.spark_partition_id())
    local = settled(parts.withColumn("__nth", F.monotonically_increasing_id() - F.shiftleft(F.col("__part").cast("long"), 33)))
    counts = local.groupBy("__part").agg(F.count("*").alias("__n"))
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.withColumn("__start", F.coalesce(F.sum("__n").over(before), F.lit(0))).drop("__n")
    return local.join(starts, "__part").withColumn(name, F.col("__start") + F.col("__nth")).drop("__part", "__nth", "__start")


def numbered_within(df: DataFrame, by: Sequence[str], order: Sequence[Column | str], name: str = "__row") -> DataFrame:
    """Rows counted from 0 in the order of their group, without bringing a large group to one task."""
    own = running_totals(df.withColumn("__one", F.lit(1).cast("long")), order, ["__one"], by)
    return own.withColumn(name, F.col("total___one") - 1).drop("__one", "total___one")


def running_totals(df: DataFrame, order: Sequence[Column | str], columns: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Adds ``total_*`` of columns up to each row of a total order, within each group of ``by``.

    Ranges of (by, order) are summed apart and then offset, so neither the whole nor a large group is in one task.
    """
    parts = settled(df.repartitionByRange(*by, *order).withColumn("__part", F.spark_partition_id()))
    own = Window.partitionBy("__part", *by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    local = parts.withColumns({f"total_{c}": F.sum(c).over(own) for c in columns})
    before = Window.partitionBy(*by).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)  # a row per partition
    sums = parts.groupBy("__part", *by).agg(*(F.sum(c).alias(f"__{c}") for c in columns))
    starts = sums.select(F.col("__part").alias("__p"), *(F.col(b).alias(f"__by{i}") for i, b in enumerate(by)), *(F.coalesce(F.sum(c).over(before), F.lit(0)).alias(c) for c in (f"__{c}" for c in columns)))
    same = reduce(lambda x, y: x & y, [F.col(b).eqNullSafe(F.col(f"__by{i}")) for i, b in enumerate(by)], F.col("__part") == F.col("__p"))
    out = local.join(starts, same).withColumns({f"total_{c}": F.col(f"total_{c}") + F.col(f"__{c}") for c in columns})
    return out.drop("__part", "__p", *(f"__by{i}" for i in range(len(by))), *(f"__{c}" for c in columns))


def chunk_join(left: DataFrame, right: DataFrame, keys: Sequence[str], size: int, order: Sequence[str]) -> DataFrame:
    """Joins the i-th ``size`` rows of one side with the i-th of the other only; keys in other chunks don't meet."""
    sides = [numbered(d, order).withColumn("__chunk", F.floor(F.col("__row") / size)).drop("__row") for d in (left, right)]
    return sides[0].join(sides[1], ["__chunk", *keys]).drop("__chunk")


def zip_rows(left: DataFrame, right: DataFrame, left_order: Sequence[str], right_order: Sequence[str]) -> DataFrame:
    """Rows paired by place; the shorter side ends it."""
    return numbered(left, left_order).join(numbered(right, right_order), "__row").drop("__row")


def overlay_corrections(raw: DataFrame, corrected: DataFrame, key: str, value: str, same: Column, missing: str = "source_not_found") -> tuple[DataFrame, DataFrame]:
    """(rows with corrections applied where ``same`` holds of raw and ``corrected_*`` columns, report on each correction)."""
    named = corrected.select(key, *(F.col(c).alias(f"corrected_{c}") for c in corrected.columns if c != key))
    both = raw.join(named.withColumn("__hit", F.lit(True)), key, "left")
    applied = F.coalesce(F.col("__hit") & same, F.lit(False))
    result = both.withColumn(value, F.when(applied, F.col(f"corrected_{value}")).otherwise(F.col(value))).select(*raw.columns, applied.alias("applied"))
    report = named.join(raw.withColumn("__found", F.lit(True)), key, "left").select(
        key,
        F.coalesce(F.col("__found") & same, F.lit(False)).alias("applied"),
        F.when(F.col("__found").isNull(), missing).when(same, "applied").otherwise("shape_mismatch").alias("reason"),
    )
    return result, report


def copy_or(base: DataFrame, table: DataFrame, key: str, value: str, missing: str = "NOT FOUND") -> DataFrame:
    """The first match's value, or a mark."""
    one = table.groupBy(key).agg(F.min(value).alias(value))
    return base.join(one, key, "left").withColumn(value, F.coalesce(value, F.lit(missing)))


def with_precedence(ids: DataFrame, tagged: DataFrame, key: str, tag: str, order: Sequence[str], missing: str | None = None) -> DataFrame:
    """Each id's tag that comes first in ``order``."""
    rank = F.coalesce(*(F.when(F.col(tag) == t, F.lit(i)) for i, t in enumerate(order)))
    best = tagged.where(rank.isNotNull()).groupBy(key).agg(F.min_by(tag, rank).alias(tag))
    out = ids.join(best, key, "left")
    return out if missing is None else out.withColumn(tag, F.coalesce(tag, F.lit(missing)))


def unknown_ids(ids: DataFrame, known: DataFrame, key: str, limit: int | None = 10) -> DataFrame:
    found = ids.join(known, key, "left_anti").select(key).distinct().orderBy(key)
    return found if limit is None else found.limit(limit)


def drop_unreplaced(rows: DataFrame, flagged: DataFrame, replaced: DataFrame, key: str) -> DataFrame:
    """Without the flagged rows for which there is no replacement."""
    return rows.join(flagged.join(replaced, key, "left_anti"), key, "left_anti")


def containing(rows: DataFrame, text: str, needles: DataFrame, needle: str, keep: bool = False) -> DataFrame:
    """Rows whose text holds none (or, with ``keep``, any) of the needles. Null and empty needles hold nowhere.

    Each distinct text's windows of the shortest needle's length meet the needles' first
    characters by equality, without the text; only what meets is looked at whole. No pairs
    of all rows are formed.
    """
    asked = needles.select(F.col(needle).alias("__needle")).where("length(__needle) > 0").distinct()
    shortest = asked.agg(F.min(F.length("__needle"))).first()[0]
    if shortest is None:
        return rows.limit(0) if keep else rows
    texts = written(rows.select(F.col(text).alias("__text")).distinct().withColumn("__id", F.monotonically_increasing_id()))
    c = F.col("__text")
    windows = F.transform(F.sequence(F.lit(1), F.length(c) - (shortest - 1)), lambda i: F.substring(c, i, F.lit(shortest)))
    windows = F.when(F.length(c) >= shortest, F.array_distinct(windows))
    starts = texts.select("__id", F.explode(windows).alias("__start"))
    met = starts.join(asked.withColumn("__start", F.substring("__needle", 1, shortest)), "__start").select("__id", "__needle")
    hits = met.join(texts, "__id").where(F.contains("__text", "__needle")).select(F.col("__text").alias(text)).distinct()
    return rows.join(hits, text, "left_semi" if keep else "left_anti")


def paired_by_name(refs: DataFrame, preds: DataFrame, path: str = "path") -> DataFrame:
    """(name, ref, pred): paths of two listings with the same file name; the first path of a name on each side."""
    name = F.element_at(F.split(path, "/"), -1)
    sides = [d.groupBy(name.alias("name")).agg(F.min(path).alias(c)) for d, c in ((refs, "ref"), (preds, "pred"))]
    return sides[0].join(sides[1], "name")


def points_in_boxes(points: DataFrame, boxes: DataFrame, group: str, cell: float, dims: Sequence[str] = ("x", "y", "z")) -> DataFrame:
    """Pairs of a point (columns ``dims``) and a box (``{d}0``, ``{d}1``) of one group that holds it, edges included, and the distance to the box's centre.

    Boxes are dealt to the grid cells that they touch on all axes, points to the one that they are in.
    """
    spread = boxes.select(F.col(group), *(F.col(c).alias(f"box_{c}") for c in boxes.columns if c != group))
    own = points.select(F.col(group), *(F.col(c).alias(f"point_{c}") for c in points.columns if c != group))
    for d in dims:
        low, high = F.floor(F.col(f"box_{d}0") / cell), F.floor(F.col(f"box_{d}1") / cell)
        spread = spread.withColumn(f"__{d}", F.explode(F.when(low <= high, F.sequence(low, high))))
        own = own.withColumn(f"__{d}", F.floor(F.col(f"point_{d}") / cell))
    keys = [f"__{d}" for d in dims]
    inside = reduce(lambda x, y: x & y, [F.col(f"point_{d}").between(F.col(f"box_{d}0"), F.col(f"box_{d}1")) for d in dims])
    away = reduce(lambda x, y: x + y, [F.pow(F.col(f"point_{d}") - (F.col(f"box_{d}0") + F.col(f"box_{d}1")) / 2, 2) for d in dims])
    return own.join(spread, [group, *keys]).where(inside).withColumn("distance", F.sqrt(away)).drop(*keys)


def by_suffix(refs: DataFrame, ref: str, preds: DataFrame, pred: str, ending: str) -> DataFrame:
    """Each reference id with the first prediction file called '...id' + ending, or null."""
    own = preds.select(pred, F.regexp_extract(pred, r"(\d{5}-\d{3})" + ending.replace(".", r"\.") + "$", 1).alias("__id"))
    first = own.where("__id <> ''").groupBy("__id").agg(F.min(pred).alias(pred))
    return refs.join(first, refs[ref] == first["__id"], "left").drop("__id")


def two_way(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Keys that only one of two sides has, with the side."""
    left, right = a.select(key).distinct().withColumn("__a", F.lit(1)), b.select(key).distinct().withColumn("__b", F.lit(1))
    both = left.join(right, key, "full_outer")
    return both.where("__a is null or __b is null").select(key, F.when(F.col("__b").isNull(), "left_only").otherwise("right_only").alias("side"))


def box_overlap(a: DataFrame, b: DataFrame, group: str, cell: float, dims: Sequence[str] = ("x", "y", "z")) -> DataFrame:
    """Pairs of boxes (columns ``{d}0``, ``{d}1``) of one group that overlap, with intersection, IoU and GIoU.

    Boxes are dealt to grid cells of all axes. A box longer than ``cell`` is in a grid whose
    cells are doubled until it touches two of them an axis at most, and a shorter one is in
    the coarser grids too that the other side has; so a wide box is few rows. A pair is
    reported by the cell of the coarser grid in which the overlap starts.
    """

    def levelled(d: DataFrame, side: str) -> DataFrame:
        own = d.select(group, *(F.col(c).alias(f"{side}_{c}") for c in d.columns if c != group))
        longest = F.greatest(F.lit(0.0), *(F.col(f"{side}_{x}1") - F.col(f"{side}_{x}0") for x in dims))
        return own.withColumn(f"__l{side}", F.greatest(F.lit(0), F.ceil(F.log2(F.greatest(longest / cell, F.lit(1.0))))).cast("int"))

    left, right = levelled(a, "a"), levelled(b, "b")
    # A level is a power of two of extents, so there are few.
    levels = sorted({r[0] for d, c in ((left, "__la"), (right, "__lb")) for r in d.select(c).distinct().collect() if r[0] is not None})

    def celled(d: DataFrame, side: str) -> DataFrame:
        d = d.withColumn("__level", F.explode(F.filter(F.array(*map(F.lit, levels)), lambda x: x >= F.col(f"__l{side}"))))
        for x in dims:
            size = cell * F.pow(F.lit(2.0), F.col("__level").cast("double"))
            low, high = F.floor(F.col(f"{side}_{x}0") / size), F.floor(F.col(f"{side}_{x}1") / size)
            d = d.withColumn(f"__c{x}", F.explode(F.when(low <= high, F.sequence(low, high))))
        return d

    def edge(d: str, f, k: int) -> Column:
        return f(F.col(f"a_{d}{k}"), F.col(f"b_{d}{k}"))

    if not levels:
        levels = [0]
    pairs = celled(left, "a").join(celled(right, "b"), [group, "__level", *(f"__c{x}" for x in dims)])
    size = cell * F.pow(F.lit(2.0), F.col("__level").cast("double"))
    first = reduce(lambda x, y: x & y, [F.floor(edge(d, F.greatest, 0) / size) == F.col(f"__c{d}") for d in dims])
    pairs = pairs.where((F.col("__level") == F.greatest("__la", "__lb")) & first).drop("__level", "__la", "__lb", *(f"__c{x}" for x in dims))
    inter = reduce(lambda x, y: x * y, [F.greatest(F.lit(0.0), edge(d, F.least, 1) - edge(d, F.greatest, 0)) for d in dims])
    hull = reduce(lambda x, y: x * y, [edge(d, F.greatest, 1) - edge(d, F.least, 0) for d in dims])

    def volume(side: str) -> Column:
        return reduce(lambda x, y: x * y, [F.col(f"{side}_{d}1") - F.col(f"{side}_{d}0") for d in dims])

    pairs = pairs.withColumns({"inter": inter, "hull": hull}).where("inter > 0")
    union = volume("a") + volume("b") - F.col("inter")
    return pairs.withColumns({"iou": F.col("inter") / union, "giou": F.col("inter") / union - (F.col("hull") - union) / F.col("hull")}).drop("hull")
