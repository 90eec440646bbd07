"""Joins that survive a key holding a large share of the rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

HOT_KEYS = 100
"""A key is hot if it holds more than one in so many of the rows, so there are fewer hot keys than this."""


def hot_keys(df: DataFrame, keys: Sequence[str], most: int = HOT_KEYS) -> DataFrame:
    """The keys that each hold more than 1/``most`` of the rows; never more than ``most`` rows."""
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    total = counts.agg(F.sum("_n")).scalar()
    return counts.where(F.col("_n") * most > total).select(*keys)


def salted_join(
    left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner", salts: int = 32
) -> DataFrame:
    """``left`` join ``right`` on ``keys`` where ``left`` may be skewed.

    ``how`` is ``inner``, ``left``, ``left_semi`` or ``left_anti``. Rows of hot keys are spread over
    ``salts`` tasks by a hash of the whole row and the right rows of those keys are repeated as often;
    all other keys are joined once. The list of hot keys is broadcast: it cannot exceed ``HOT_KEYS``.
    NULL keys match nothing.
    """
    hot = F.broadcast(hot_keys(left, keys).withColumn("_hot", F.lit(True)))
    mixed = F.pmod(F.xxhash64(*[F.col(c) for c in left.columns if dict(left.dtypes)[c][:3] != "map"]), F.lit(salts)).cast("int")
    a = left.join(hot, list(keys), "left").withColumn("_salt", F.when(F.col("_hot"), mixed).otherwise(F.lit(0))).drop("_hot")
    every = F.when(F.col("_hot"), F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))
    b = right.join(hot, list(keys), "left").withColumn("_salt", F.explode(every)).drop("_hot")
    return a.join(b, [*keys, "_salt"], how).drop("_salt")
