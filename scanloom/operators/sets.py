"""Set operators and row contracts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class ContractError(ValueError):
    """Rows that break a stated contract; the message names some."""


def union_rows(*frames: DataFrame) -> DataFrame:
    """All rows; columns that a side lacks are null."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def require_unique(df: DataFrame, key: str, what: str = "row") -> DataFrame:
    bad = [r[0] for r in df.groupBy(key).count().where("count > 1").select(key).limit(10).collect()]
    if bad:
        raise ContractError(f"{what} ids occur more than once: {bad}")
    return df


def union_unique(key: str, *frames: DataFrame) -> DataFrame:
    return require_unique(union_rows(*frames), key)


def require_columns(df: DataFrame, required: Sequence[str]) -> DataFrame:
    if missing := [c for c in required if c not in df.columns]:
        raise ContractError(f"columns missing: {missing}")
    return df


def require_empty(df: DataFrame, what: str) -> None:
    if rows := df.limit(10).collect():
        raise ContractError(f"{what}: {[tuple(r) for r in rows]}")


def in_every(df: DataFrame, item: str, group: str) -> DataFrame:
    """Items that some group lacks, with the number of groups that have them."""
    n = df.select(F.count_distinct(group)).first()[0]
    return df.groupBy(item).agg(F.count_distinct(group).alias("groups")).where(F.col("groups") < n)


def id_match(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Counts of ids in both, in either, and in one only."""
    left, right = a.select(key).distinct().withColumn("a", F.lit(1)), b.select(key).distinct().withColumn("b", F.lit(1))
    both = left.join(right, key, "full_outer")
    return both.agg(
        F.count_if(F.col("a").isNotNull() & F.col("b").isNotNull()).alias("both"),
        F.count("*").alias("either"),
        F.count_if(F.col("b").isNull()).alias("only_a"),
        F.count_if(F.col("a").isNull()).alias("only_b"),
    )


def pad_columns(df: DataFrame, columns: Sequence[str], value: str = "") -> DataFrame:
    return df.withColumns({c: F.lit(value) for c in columns if c not in df.columns})


def fill(df: DataFrame, defaults: dict) -> DataFrame:
    """Nulls, and NaN in fractional columns, to each column's default."""
    kinds = dict(df.dtypes)
    done = {}
    for c, v in defaults.items():
        own = F.nanvl(F.col(c), F.lit(None)) if kinds[c] in ("float", "double") else F.col(c)
        done[c] = F.coalesce(own, F.lit(v).cast(kinds[c]))
    return df.withColumns(done)


def grouped_columns(df: DataFrame, groups: dict[str, Sequence[str]]) -> DataFrame:
    """Column groups as one array column each."""
    used = {c for cs in groups.values() for c in cs}
    return df.select(*(c for c in df.columns if c not in used), *(F.array(*cs).alias(g) for g, cs in groups.items()))


def routed(df: DataFrame, accept: Column) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected); a null condition rejects."""
    ok = F.coalesce(accept, F.lit(False))
    return df.where(ok), df.where(~ok)


def unpivot(df: DataFrame, ids: Sequence[str], columns: Sequence[str], name: str, value: str) -> DataFrame:
    return df.unpivot(list(ids), list(columns), name, value)


def top(df: DataFrame, n: int, *order: Column | str) -> DataFrame:
    return df.orderBy(*order).limit(n)
