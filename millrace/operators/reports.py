"""Report operators over a fact table: totals, shares, ratios, growth, tops and bottoms."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions.numbers import percent_change, ratio


def totals(df: DataFrame, measures: Mapping[str, Column], by: Sequence[str] = ()) -> DataFrame:
    """Measures over all rows (one row, also for an empty table) or by group."""
    out = [c.alias(n) for n, c in measures.items()]
    return df.groupBy(*by).agg(*out) if by else df.agg(*out)


def with_share(df: DataFrame, value: str, name: str, within: Sequence[str] = ()) -> DataFrame:
    """Add the percentage of ``value`` in its total, over all rows or within groups.

    Meant for aggregated rows. The total over all rows is a scalar subquery, not a window, which would
    move all rows to one task; within groups it is a window. NULL values have a NULL share; a total of 0
    gives NULL.
    """
    if within:
        return df.withColumn(name, 100.0 * ratio(F.col(value), F.sum(value).over(Window.partitionBy(*within))))
    total = df.agg(F.sum(value)).scalar()
    return df.withColumn(name, 100.0 * ratio(F.col(value), total))


def ratio_of_sums(df: DataFrame, by: Sequence[str], numerator: Column, denominator: Column, count: Column, least: int = 1) -> DataFrame:
    """100 * sum / sum by group, for groups of at least ``least`` counted things: ``numerator, denominator, n, pct``."""
    out = df.groupBy(*by).agg(F.sum(numerator).alias("numerator"), F.sum(denominator).alias("denominator"), count.alias("n"))
    return out.where(F.col("n") >= least).withColumn("pct", 100.0 * ratio(F.col("numerator"), F.col("denominator")))


def rate(df: DataFrame, by: Sequence[str], flag: Column, least: int = 1) -> DataFrame:
    """Rows, flagged rows and their percentage by group; a NULL flag is not flagged."""
    out = df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.count_if(flag).alias("flagged"))
    return out.where(F.col("n") >= least).withColumn("pct", 100.0 * ratio(F.col("flagged"), F.col("n")))


def growth(df: DataFrame, period: str, value: str, lag: int, name: str, by: Sequence[str] = ()) -> DataFrame:
    """Add the percentage change against the row ``lag`` periods before, by position. One row per period and group expected."""
    w = Window.partitionBy(*by).orderBy(period)
    return df.withColumn(name, percent_change(F.col(value), F.lag(value, lag).over(w)))


def growth_by_month(df: DataFrame, month: str, value: str, months: int, name: str, by: Sequence[str] = ()) -> DataFrame:
    """Add the percentage change against the same month ``months`` before; NULL where that month is missing."""
    before = df.select(*by, F.add_months(month, months).alias(month), F.col(value).alias("_before"))
    return df.join(before, [*by, month], "left").withColumn(name, percent_change(F.col(value), F.col("_before"))).drop("_before")


def top(df: DataFrame, n: int, order: Sequence[Column]) -> DataFrame:
    """The first n rows of a total order; state a unique last key to make ties certain."""
    return df.orderBy(*order).limit(n)


def top_and_bottom(df: DataFrame, n: int, value: str, key: str) -> DataFrame:
    """The n highest and the n lowest rows, tagged ``end``."""
    high = top(df, n, [F.desc_nulls_last(value), F.asc(key)]).withColumn("end", F.lit("top"))
    low = top(df, n, [F.asc_nulls_last(value), F.asc(key)]).withColumn("end", F.lit("bottom"))
    return high.unionByName(low)


def top_per_group(df: DataFrame, by: Sequence[str], order: Sequence[Column], n: int = 1, name: str = "position") -> DataFrame:
    """The first n rows of every group, numbered from 1. Spark keeps only n rows a partition before the shuffle."""
    w = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn(name, F.row_number().over(w)).where(F.col(name) <= n)


def pivot(df: DataFrame, by: Sequence[str], column: str, values: Sequence, aggregate: Column) -> DataFrame:
    """One column per stated value; stating them saves a pass and fixes the order."""
    return df.groupBy(*by).pivot(column, list(values)).agg(aggregate)


def value_counts(df: DataFrame, column: str) -> DataFrame:
    return with_share(df.groupBy(column).agg(F.count(F.lit(1)).alias("n")), "n", "pct")


def profile(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Per column: rows, NULLs, their percentage and distinct values, in one pass: ``column, rows, nulls, null_pct, distinct_values``."""
    names = list(columns or df.columns)
    one = df.agg(
        F.count(F.lit(1)).alias("_rows"),
        *[F.count_if(F.col(f"`{c}`").isNull()).alias(f"n_{i}") for i, c in enumerate(names)],
        *[F.count_distinct(F.col(f"`{c}`")).alias(f"d_{i}") for i, c in enumerate(names)],
    )
    parts = F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"n_{i}").alias("nulls"), F.col(f"d_{i}").alias("distinct_values")) for i, c in enumerate(names)])
    return one.select("_rows", F.explode(parts).alias("x")).select(
        "x.column", F.col("_rows").alias("rows"), "x.nulls", (100.0 * ratio(F.col("x.nulls"), F.col("_rows"))).alias("null_pct"), "x.distinct_values"
    )


def duplicate_rows(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Surplus rows beyond the first of each distinct row: ``rows, distinct_rows, surplus``."""
    groups = df.groupBy(*(columns or df.columns)).agg(F.count(F.lit(1)).alias("_n"))
    return groups.agg(
        F.coalesce(F.sum("_n"), F.lit(0)).alias("rows"), F.count(F.lit(1)).alias("distinct_rows"),
        (F.coalesce(F.sum("_n"), F.lit(0)) - F.count(F.lit(1))).alias("surplus"),
    )


def hash_sample(df: DataFrame, keys: Sequence[str], share: float, seed: int = 42) -> DataFrame:
    """A sample by a hash of the keys: the same rows every time, and all rows of a key or none."""
    dice = F.pmod(F.xxhash64(*keys, F.lit(seed)), F.lit(1_000_000))
    return df.where(dice < int(share * 1_000_000))


def in_list_order(df: DataFrame, column: str, order: Sequence) -> DataFrame:
    """Rows sorted by a stated order of values, others last."""
    place = F.array_position(F.array(*[F.lit(x) for x in order]), F.col(column))
    return df.orderBy(F.when(place == 0, len(order) + 1).otherwise(place), F.asc_nulls_last(column))


def row_profile(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Each of the columns as a share of the row's largest value."""
    largest = F.greatest(*[F.col(c) for c in columns]) if len(columns) > 1 else F.col(columns[0])
    return df.withColumns({c: ratio(F.col(c), largest) for c in columns})


def near_copies(df: DataFrame, key: str, normalized: Column) -> DataFrame:
    """Rows that share a normalised text: ``key, first_key, copies``; the smallest key stands for its group."""
    rows = df.select(F.col(key).alias("_k"), F.xxhash64(normalized).alias("_h"), normalized.alias("_t")).where("_t IS NOT NULL")
    groups = rows.groupBy("_h", "_t").agg(F.min("_k").alias("first_key"), F.count(F.lit(1)).alias("copies")).where("copies > 1")
    return rows.join(groups, ["_h", "_t"]).select(F.col("_k").alias(key), "first_key", "copies")


def share_of_columns(df: DataFrame, conditions: dict[str, Column]) -> DataFrame:
    """In how many percent of the rows each condition holds: ``column, pct``, in one pass."""
    one = df.agg(F.count(F.lit(1)).alias("_n"), *[F.count_if(c).alias(f"c{i}") for i, c in enumerate(conditions.values())])
    pairs = F.array(*[F.struct(F.lit(n).alias("column"), (100.0 * ratio(F.col(f"c{i}"), F.col("_n"))).alias("pct")) for i, n in enumerate(conditions)])
    return one.select(F.explode(pairs).alias("x")).select("x.*")


def in_given_order(df: DataFrame, column: str, values: Sequence[str]) -> DataFrame:
    """Rows ordered by the place of their value in a list; values that are not listed come last."""
    return df.orderBy(F.coalesce(F.nullif(F.array_position(F.array(*[F.lit(v) for v in values]), F.col(column)), F.lit(0)), F.lit(len(values) + 1)))
