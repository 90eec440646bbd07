"""Keeping the latest row per key and merging batches into tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def latest_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[str], first: bool = False) -> DataFrame:
    """One row per key: the one that is greatest in ``order`` (least with ``first``), ties broken by all other columns.

    An aggregate with partial results, not a window, so a key with a third of all rows shuffles one row
    per partition. NULL keys are a key of their own; NULLs in ``order`` count as the least.
    """
    rest = [c for c in df.columns if c not in keys]
    tie = [c for c in rest if c not in order and not dict(df.dtypes)[c].startswith("map")]
    pick = F.min_by if first else F.max_by
    row = F.struct(*[F.col(f"`{c}`") for c in rest])
    at = F.struct(*[F.col(f"`{c}`") for c in [*order, *tie]])
    out = df.groupBy(*keys).agg(pick(row, at).alias("_row"))
    return out.select(*[F.col(f"`{c}`") if c in keys else F.col("_row").getField(c).alias(c) for c in df.columns])


def merge(target: DataFrame, source: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Upsert: rows of ``source`` replace those of ``target`` with equal keys, others are added.

    New columns of either side are kept and filled with NULL. Keys in ``source`` have to be unique
    (see ``latest_per_key``). A NULL key matches nothing, so its rows are added.
    """
    kept = target.join(source.select(*keys).distinct(), list(keys), "left_anti")
    return kept.unionByName(source, allowMissingColumns=True)


def changes(target: DataFrame, source: DataFrame, keys: Sequence[str], compare: Sequence[str]) -> DataFrame:
    """What a merge would do to each key of ``source``: ``keys, action`` (insert, update or same)."""
    mark = target.select(*keys, F.struct(*compare).alias("_old"))
    joined = source.select(*keys, F.struct(*compare).alias("_new")).join(mark, list(keys), "left")
    action = F.when(F.col("_old").isNull(), "insert").when(F.col("_old").eqNullSafe(F.col("_new")), "same").otherwise("update")
    return joined.select(*keys, action.alias("action"))


def add_missing(target: DataFrame, source: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Insert on conflict do nothing: rows of ``source`` whose keys are not in ``target`` are added, one per key."""
    fresh = source.join(target.select(*keys), list(keys), "left_anti").dropDuplicates(list(keys))
    return target.unionByName(fresh, allowMissingColumns=True)


def missing_keys(child: DataFrame, column: str, parent: DataFrame, key: str) -> DataFrame:
    """Distinct non-NULL values of a foreign key without a parent row: ``value``."""
    have = parent.select(F.col(key).alias("value"))
    return child.select(F.col(column).alias("value")).where("value IS NOT NULL").distinct().join(have, "value", "left_anti")


def forward_fill(df: DataFrame, keys: Sequence[str], order: str, columns: Sequence[str], mean: bool = True) -> DataFrame:
    """Fill gaps from the row before, then from the row after, then with the key's mean."""
    from pyspark.sql import Window

    before = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    after = Window.partitionBy(*keys).orderBy(order).rowsBetween(0, Window.unboundedFollowing)
    every = Window.partitionBy(*keys)
    filled: dict[str, Column] = {}
    for c in columns:
        parts = [F.last(c, ignorenulls=True).over(before), F.first(c, ignorenulls=True).over(after)]
        filled[c] = F.coalesce(*parts, *([F.avg(c).over(every)] if mean else []))
    return df.withColumns(filled)
