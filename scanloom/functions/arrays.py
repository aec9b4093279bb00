"""Array, box and map expressions."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def pad_array(c: Column, before: int, after: int, value: float = 0.0) -> Column:
    v = F.lit(value)
    return F.concat(F.array_repeat(v, before), c, F.array_repeat(v, after))


def crop_array(c: Column, start: int, size: int) -> Column:
    return F.slice(c, start + 1, size)


def centre_array(c: Column, size: int, value: float = 0.0) -> Column:
    """Cut or padded about the middle to ``size``."""
    n = F.size(c)
    lack = F.greatest(F.lit(size) - n, F.lit(0))
    before = F.floor(lack / 2).cast("int")
    wide = F.concat(F.array_repeat(F.lit(value), before), c, F.array_repeat(F.lit(value), (lack - before).cast("int")))
    start = F.greatest(F.floor(F.size(wide) / 2) - size // 2, F.lit(0)).cast("int")
    return F.slice(wide, start + 1, F.lit(size))


def where_equal(c: Column, value: Column) -> Column:
    """Places, from 0, that hold a value."""
    return F.filter(F.transform(c, lambda x, i: F.when(x == value, i)), lambda i: i.isNotNull())


def corners_to_centre(x0: Column, y0: Column, x1: Column, y1: Column) -> dict[str, Column]:
    return {"cx": (x0 + x1) / 2, "cy": (y0 + y1) / 2, "w": x1 - x0, "h": y1 - y0}


def centre_to_corners(cx: Column, cy: Column, w: Column, h: Column) -> dict[str, Column]:
    return {"x0": cx - w / 2, "y0": cy - h / 2, "x1": cx + w / 2, "y1": cy + h / 2}


def clipped_box(box: Mapping[str, Column], width: float, height: float) -> dict[str, Column]:
    top = {"x0": width, "x1": width, "y0": height, "y1": height}
    return {k: F.least(F.greatest(c, F.lit(0.0)), F.lit(top[k])) for k, c in box.items()}


def box_area(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    return F.greatest(x1 - x0, F.lit(0.0)) * F.greatest(y1 - y0, F.lit(0.0))


def collated(df: DataFrame, by: Sequence[str], columns: Sequence[str], order: str) -> DataFrame:
    """Rows of a batch as one row of arrays, in order."""
    rows = F.array_sort(F.collect_list(F.struct(order, *columns)))
    d = df.groupBy(*by).agg(rows.alias("__r"))
    return d.select(*by, *(F.col(f"__r.{c}").alias(c) for c in columns))


def decollated(df: DataFrame, by: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """A row of arrays back to rows, numbered from 0."""
    d = df.select(*by, F.posexplode(F.arrays_zip(*columns)).alias("place", "__r"))
    return d.select(*by, "place", *(F.col(f"__r.{c}").alias(c) for c in columns))


def first_key(json_text: Column, paths: Sequence[str]) -> Column:
    """The first of several JSON paths that has a value."""
    return F.coalesce(*(F.get_json_object(json_text, p) for p in paths))


def sorted_map(c: Column) -> Column:
    return F.array_sort(F.map_entries(c))


def numeric_version(c: Column) -> Column:
    """'1.10.2' to [1, 10, 2], so that versions sort as numbers."""
    return F.transform(F.split(F.regexp_extract(c, r"(\d+(?:\.\d+)*)", 1), r"\."), lambda x: x.cast("int"))
