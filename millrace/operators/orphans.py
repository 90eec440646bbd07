"""References to records that do not exist, are deleted or arrive later (problem 5)."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.operators.scan import carried
from millrace.operators.skew import salted_join
from millrace.runtime import cut

FOREVER = "9999-12-31 23:59:59"


@dataclass(frozen=True)
class Reference:
    """A foreign key: rows ``child`` point with ``column`` to ``parent_key`` of ``parent``."""

    child_name: str
    child: DataFrame
    row_key: str
    column: str
    at: str
    parent_name: str
    parent: DataFrame
    parent_key: str
    loaded_at: str
    deleted_at: str


def _children(refs: Sequence[Reference]) -> DataFrame:
    parts = [
        r.child.select(
            F.lit(r.parent_name).alias("parent_table"),
            F.col(r.column).cast("string").alias("key"),
            F.lit(r.child_name).alias("table_name"),
            F.col(r.row_key).cast("string").alias("row_key"),
            F.col(r.at).alias("at"),
        ).where("key IS NOT NULL")
        for r in refs
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _parents(refs: Sequence[Reference]) -> DataFrame:
    seen: dict[str, DataFrame] = {}
    for r in refs:
        seen.setdefault(
            r.parent_name,
            r.parent.select(
                F.lit(r.parent_name).alias("parent_table"),
                F.col(r.parent_key).cast("string").alias("key"),
                F.struct(F.col(r.loaded_at).alias("loaded_at"), F.col(r.deleted_at).alias("deleted_at")).alias("life"),
            ).where("key IS NOT NULL"),
        )
    out = None
    for p in seen.values():
        out = p if out is None else out.unionByName(p)
    return out


def key_groups(refs: Sequence[Reference]) -> DataFrame:
    """Tagged parent and child keys in long form, grouped by parent table and key.

    Output per group with references: ``children``, ``undated`` ones among them, ``first_at`` of the others,
    ``parents``, and ``open_since``, the earliest load of a parent row that was never deleted. All of these are folded
    before the shuffle, so a key that holds a third of all rows costs one row per partition.
    """
    child = _children(refs).select(
        "parent_table", "key", F.lit(1).alias("child"), F.col("at").cast("timestamp_ntz").alias("at"), F.lit(None).cast("timestamp_ntz").alias("open")
    )
    life = F.when(F.col("life.deleted_at").isNull(), F.col("life.loaded_at")).cast("timestamp_ntz")
    parent = _parents(refs).select("parent_table", "key", F.lit(0).alias("child"), F.lit(None).cast("timestamp_ntz").alias("at"), life.alias("open"))
    return (
        child.unionByName(parent)
        .groupBy("parent_table", "key")
        .agg(
            F.sum("child").alias("children"),
            F.sum(1 - F.col("child")).alias("parents"),
            F.count_if((F.col("child") == 1) & F.col("at").isNull()).alias("undated"),
            F.min("at").alias("first_at"),
            F.min("open").alias("open_since"),
        )
        .where("children > 0")
    )


def orphans(refs: Sequence[Reference]) -> DataFrame:
    """The referencing rows whose target is missing at their own time.

    Output: ``table_name, row_key, period`` (yyyy-MM of the row's time), one row per referencing row;
    repeated deliveries of a row count once. A reference is sound if the parent table has a row of
    that key loaded at or before the row's time and not deleted by then. A NULL reference is no
    reference. A row without a time cannot have a parent in time and is reported with a NULL period.

    Groups without parents are orphans as a whole, and groups that a parent row stands for since before their first
    reference are sound. The rows of the others are put in the order of time with the lifetimes of their parents: a
    reference is sound if the latest end of what was loaded by then lies after it. That runs in blocks of a
    month, so neither a key's references nor its parent rows have to fit a task.
    """
    groups = key_groups(refs)
    sound = F.coalesce(F.col("open_since") <= F.col("first_at"), F.lit(False)) & (F.col("undated") == 0)
    open_ = cut(groups.where(~sound).select("parent_table", "key", (F.col("parents") > 0).alias("has_parent")))
    rows = cut(salted_join(_children(refs), open_, ["parent_table", "key"]))
    lacking = rows.where(~F.col("has_parent") | F.col("at").isNull()).select("table_name", "row_key", "at")

    doubtful = open_.where("has_parent").select("parent_table", "key")
    lives = salted_join(_parents(refs), doubtful, ["parent_table", "key"], "left_semi").where("life.loaded_at IS NOT NULL")
    until = F.coalesce(F.col("life.deleted_at").cast("timestamp_ntz"), F.lit(FOREVER).cast("timestamp_ntz"))
    none = F.lit(None).cast("string")
    loads = lives.select("parent_table", "key", F.col("life.loaded_at").cast("timestamp_ntz").alias("at"), F.lit(0).alias("child"), until.alias("until"), none.alias("table_name"), none.alias("row_key"))
    asked = rows.where(F.col("has_parent") & F.col("at").isNotNull()).select(
        "parent_table", "key", F.col("at").cast("timestamp_ntz").alias("at"), F.lit(1).alias("child"), F.lit(None).cast("timestamp_ntz").alias("until"), "table_name", "row_key"
    )
    keys = ["parent_table", "key"]
    line = loads.unionByName(asked).withColumn("month", F.trunc(F.col("at").cast("date"), "MM"))
    before = carried(line, keys, "month", {"reached": F.max("until")}, {"reached": "max"})
    inside = Window.partitionBy(*keys, "month").orderBy("at", "child").rowsBetween(Window.unboundedPreceding, 0)
    line = line.withColumn("here", F.max("until").over(inside)).join(before, [*keys, "month"])
    alive = F.coalesce(F.greatest("here", "reached") > F.col("at"), F.lit(False))
    missed = line.where((F.col("child") == 1) & ~alive).select("table_name", "row_key", "at")
    return (
        lacking.select("table_name", "row_key", F.col("at").cast("timestamp_ntz").alias("at")).unionByName(missed)
        .groupBy("table_name", "row_key")
        .agg(F.min(F.date_format("at", "yyyy-MM")).alias("period"))
    )


def orphan_report(refs: Sequence[Reference]) -> DataFrame:
    """Orphan rows per table and month: ``table_name, period, orphan_rows``."""
    return orphans(refs).groupBy("table_name", "period").agg(F.count(F.lit(1)).alias("orphan_rows"))
