"""Running values along an order, computed in two levels so that no key is held by one task.

A window over a whole key puts every row of that key into one task. Here a key is divided into blocks
(a calendar day, a month, a range of values): windows run inside a block, and what a block inherits
from the blocks before it comes from a table with one row per key and block.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def carried(
    df: DataFrame, keys: Sequence[str], block: str, aggregates: dict[str, Column], running: dict[str, str]
) -> DataFrame:
    """One row per key and block with what the earlier blocks leave behind.

    ``aggregates`` summarise a block; ``running`` names for each of them how the earlier blocks are
    combined: ``max``, ``min`` or ``sum``.
    """
    per_block = df.groupBy(*keys, block).agg(*[c.alias(n) for n, c in aggregates.items()])
    before = Window.partitionBy(*keys).orderBy(block).rowsBetween(Window.unboundedPreceding, -1)
    combine = {"max": F.max, "min": F.min, "sum": F.sum}
    return per_block.select(
        *keys, block, *[combine[how](name).over(before).alias(name) for name, how in running.items()]
    )


def with_position(df: DataFrame, keys: Sequence[str], block: str, order: Sequence[str | Column], name: str) -> DataFrame:
    """Number the rows of each key from 0 in the order of ``block`` and then ``order``."""
    before = carried(df, keys, block, {"_n": F.count(F.lit(1))}, {"_n": "sum"})
    inside = Window.partitionBy(*keys, block).orderBy(*order)
    return (
        df.withColumn("_at", F.row_number().over(inside))
        .join(before, [*keys, block])
        .withColumn(name, F.coalesce("_n", F.lit(0)) + F.col("_at") - 1)
        .drop("_n", "_at")
    )


def running_total(
    df: DataFrame, keys: Sequence[str], block: str, order: Sequence[str | Column], value: str, name: str
) -> DataFrame:
    """Add ``name``: the sum of ``value`` over the rows of the key before this one."""
    before = carried(df, keys, block, {"_n": F.sum(value)}, {"_n": "sum"})
    inside = Window.partitionBy(*keys, block).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return (
        df.withColumn("_at", F.coalesce(F.sum(value).over(inside), F.lit(0)))
        .join(before, [*keys, block])
        .withColumn(name, F.coalesce("_n", F.lit(0)) + F.col("_at"))
        .drop("_n", "_at")
    )
