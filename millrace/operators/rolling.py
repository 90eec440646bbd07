"""Trailing-period totals per entity and calendar day (problem 2)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def daily_totals(df: DataFrame, entity: str, day: str, value: str, version: str | None = None) -> DataFrame:
    """One row per entity and day: ``entity, day, value``.

    With ``version``, rows of the same entity and day are deliveries of one reading and the latest
    one counts (ties: the larger value); without it they add up. NULL values count as 0. Rows with a
    NULL entity or day belong to no series and are left out.
    """
    rows = df.select(
        F.col(entity).alias("entity"),
        F.col(day).cast("date").alias("day"),
        F.col(value).alias("value"),
        *([F.col(version).alias("version")] if version else []),
    ).where("entity IS NOT NULL AND day IS NOT NULL")
    if version:
        total = F.max_by("value", F.struct("version", "value"))
    else:
        total = F.sum("value")
    return rows.groupBy("entity", "day").agg(F.coalesce(total, F.lit(0)).alias("value"))


def trailing_totals(
    df: DataFrame,
    entity: str,
    day: str,
    value: str,
    periods: Sequence[int] = (7, 30),
    version: str | None = None,
) -> DataFrame:
    """Totals and averages over trailing periods for each entity and each calendar day.

    Every day between an entity's first and last row gets a row, with or without activity. Each daily
    total is exploded onto the output dates that it influences (the day itself and the longest
    period less one day after it), the parts are summed by entity and date, and calendar rows bring
    the zeros. ``avg_N`` is the total over N calendar days. Output: ``entity, day, total_N, avg_N``.

    The explosion never meets the network: daily totals are first laid out by entity and calendar
    month, so that the partial sums of one partition fold the copies back into about two months of
    dates before they are shuffled. A busy entity is spread over its months.

    Empty input gives no rows; NULL values count as 0; negative or faulty values count as they stand.
    """
    longest = max(periods)
    days = daily_totals(df, entity, day, value, version)
    laid = days.withColumn("month", F.trunc("day", "MM")).repartition("entity", "month")
    ends = days.groupBy("entity").agg(F.min("day").alias("first"), F.max("day").alias("last"))
    parts = laid.select("entity", "day", "value", F.explode(F.sequence(F.lit(0), F.lit(longest - 1))).alias("lag"))
    sums = parts.groupBy("entity", F.date_add("day", F.col("lag")).alias("day")).agg(
        *[F.sum(F.when(F.col("lag") < n, F.col("value"))).alias(f"total_{n}") for n in periods]
    )
    calendar = ends.select("entity", F.explode(F.sequence("first", "last")).alias("day"))
    joined = calendar.join(sums, ["entity", "day"], "left")
    out = [F.coalesce(F.col(f"total_{n}"), F.lit(0)) for n in periods]
    return joined.select(
        "entity",
        "day",
        *[t.alias(f"total_{n}") for t, n in zip(out, periods)],
        *[(t / F.lit(float(n))).alias(f"avg_{n}") for t, n in zip(out, periods)],
    )
