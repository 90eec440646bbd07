"""Time series per group: rolling statistics, anomalies, forecast errors, gaps and baselines."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions.numbers import ratio
from millrace.operators.stats import percentiles


def rolling(df: DataFrame, keys: Sequence[str], order: str, value: str, rows: int, least: int, shift: int = 0) -> tuple[Column, Column]:
    """Mean and sample deviation over the last ``rows`` rows, ending ``shift`` rows before; NULL with fewer than ``least`` values."""
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(-(rows - 1) - shift, -shift)
    enough = F.count(value).over(w) >= least
    return F.when(enough, F.avg(value).over(w)), F.when(enough, F.stddev_samp(value).over(w))


def residual_anomalies(
    df: DataFrame, keys: Sequence[str], order: str, actual: str, forecast: str, window: int = 14, z_limit: float = 2.0, both: bool = True
) -> DataFrame:
    """Days whose forecast error is far out: rolling z score above the limit and outside the quartile fences.

    Adds ``residual, z, outside, is_anomaly, severity, direction``. Groups with fewer rows than the
    window give no rows. A rolling deviation of 0 or NULL is replaced by the group's median absolute
    residual, or 1. Severity: above 3 critical, above 2.5 moderate, else minor.
    """
    rows = df.where(F.col(actual).isNotNull() & F.col(forecast).isNotNull()).withColumn("residual", F.col(actual) - F.col(forecast))
    sizes = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= window)
    quartiles = percentiles(rows, keys, "residual", [0.25, 0.75]).withColumnRenamed("percentiles", "_q")
    middles = percentiles(rows.withColumn("_size", F.abs("residual")), keys, "_size", [0.5]).select(*keys, F.col("percentiles")[0].alias("_mad"))
    fences = sizes.join(quartiles, list(keys)).join(middles, list(keys))
    mean, std = rolling(rows, keys, order, "residual", window, max(7, window // 2))
    rows = rows.withColumn("_mean", mean).withColumn("_std", std).join(fences, list(keys))
    spare = F.when(F.col("_mad") > 0, F.col("_mad")).otherwise(1.0)
    scale = F.when(F.col("_std") > 0, F.col("_std")).otherwise(spare)
    iqr = F.col("_q")[1] - F.col("_q")[0]
    out = rows.withColumn("z", (F.col("residual") - F.col("_mean")) / scale).withColumn(
        "outside", (F.col("residual") < F.col("_q")[0] - 1.5 * iqr) | (F.col("residual") > F.col("_q")[1] + 1.5 * iqr)
    )
    far = F.coalesce(F.abs("z") > z_limit, F.lit(False))
    flag = far & F.col("outside") if both else far | F.col("outside")
    size = F.abs("z")
    return out.withColumns(
        {
            "is_anomaly": flag,
            "severity": F.when(flag, F.when(size > 3, "critical").when(size > 2.5, "moderate").otherwise("minor")),
            "direction": F.when(flag, F.when(F.col("residual") > 0, "HIGH").otherwise("LOW")),
        }
    ).drop("_n", "_q", "_mad", "_mean", "_std")


def baseline_anomalies(df: DataFrame, keys: Sequence[str], order: str, value: str, window: int = 30, least: int = 14, z_limit: float = 2.0) -> DataFrame:
    """The same for a series without forecasts: the baseline is the mean of the ``window`` rows before.

    Adds ``baseline, residual, z, is_anomaly``; rows without a baseline are left out.
    """
    mean, _ = rolling(df, keys, order, value, window, least, shift=1)
    rows = df.withColumn("baseline", mean).where("baseline IS NOT NULL").withColumn("residual", F.col(value) - F.col("baseline"))
    _, std = rolling(rows, keys, order, "residual", window, least, shift=1)
    spread = rows.groupBy(*keys).agg(F.stddev_samp("residual").alias("_all"))
    rows = rows.withColumn("_std", std).join(spread, list(keys))
    scale = F.when(F.col("_std") > 0, F.col("_std")).when(F.col("_all") > 0, F.col("_all")).otherwise(1.0)
    return rows.withColumn("z", F.col("residual") / scale).withColumn("is_anomaly", F.abs("z") > z_limit).drop("_std", "_all")


def forecast_errors(df: DataFrame, keys: Sequence[str], actual: str, forecast: str, warning: float = 20.0, error: float = 35.0, least: int = 1) -> DataFrame:
    """``n, mae, mape, rmse, status`` per group. MAPE skips actual values of 0 and is infinite if there are only those."""
    rows = df.where(F.col(actual).isNotNull() & F.col(forecast).isNotNull())
    e = F.col(actual).cast("double") - F.col(forecast)
    out = rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.avg(F.abs(e)).alias("mae"),
        F.coalesce(100.0 * F.avg(F.when(F.col(actual) != 0, F.abs(e / F.when(F.col(actual) != 0, F.col(actual))))), F.lit(float("inf"))).alias("mape"),
        F.sqrt(F.avg(e * e)).alias("rmse"),
    )
    status = F.when(F.col("n") < least, "insufficient_data").when(F.col("mape") > error, "error").when(F.col("mape") > warning, "warning").otherwise("ok")
    return out.withColumn("status", status)


def calendar_days(df: DataFrame, keys: Sequence[str], day: str) -> DataFrame:
    """Every day from the first to the last day of each group: ``keys, day``."""
    span = df.where(F.col(day).isNotNull()).groupBy(*keys).agg(F.min(day).alias("_a"), F.max(day).alias("_b"))
    return span.select(*keys, F.explode(F.sequence("_a", "_b")).alias(day))


def missing_days(df: DataFrame, keys: Sequence[str], day: str) -> DataFrame:
    """Days without a row between the first and the last day of each group."""
    return calendar_days(df, keys, day).join(df.select(*keys, day).distinct(), [*keys, day], "left_anti")


def seasonal_naive(df: DataFrame, keys: Sequence[str], order: str, value: str, rows: int = 28, least: int = 7) -> DataFrame:
    """Add ``forecast``: the mean of the rows before, as a plain baseline."""
    mean, _ = rolling(df, keys, order, value, rows, least, shift=1)
    return df.withColumn("forecast", mean)


def rolling_origins(df: DataFrame, day: str, initial: int, period: int, horizon: int) -> DataFrame:
    """Cross-validation folds of a series: every row with the cutoffs whose horizon holds it or whose training part does.

    Adds ``cutoff`` and ``part`` (train or test). Cutoffs run from the first day plus ``initial`` in steps
    of ``period`` while the horizon fits.
    """
    ends = df.agg(F.min(day).alias("a"), F.max(day).alias("b"))
    a, b = ends.select("a").scalar(), ends.select("b").scalar()
    n = F.floor((F.datediff(b, a) - initial - horizon) / period)
    folds = F.when(n >= 0, F.sequence(F.lit(0), F.greatest(n, F.lit(0)).cast("int")))
    every = df.withColumn("_fold", F.explode(folds)).withColumn("cutoff", F.date_add(a, F.col("_fold") * period + initial)).drop("_fold")
    every = every.where(F.col(day) <= F.date_add("cutoff", horizon))
    return every.withColumn("part", F.when(F.col(day) <= F.col("cutoff"), "train").otherwise("test"))


def lift_between(df: DataFrame, by: Sequence[str], flag: Column, value: str) -> DataFrame:
    """Mean with and without a condition and the percentage between them: ``with_mean, without_mean, pct_change``."""
    out = df.groupBy(*by).agg(F.avg(F.when(flag, F.col(value))).alias("with_mean"), F.avg(F.when(~flag, F.col(value))).alias("without_mean"))
    return out.withColumn("pct_change", 100.0 * ratio(F.col("with_mean") - F.col("without_mean"), F.col("without_mean")))


def trailing_count(df: DataFrame, key: str, at: str, seconds: int, name: str = "in_window") -> DataFrame:
    """Add how many rows of the same key lie in the ``seconds`` up to and including each row (ties count).

    Rows are dealt to time blocks of that length and repeated in the next one, so a busy key is
    counted by as many tasks as it has blocks. Rows without key or time are left out.
    """
    us = F.unix_micros(F.col(at).cast("timestamp"))
    span = seconds * 1_000_000
    rows = df.where(F.col(key).isNotNull() & F.col(at).isNotNull()).withColumn("_us", us).withColumn("_home", F.floor(F.col("_us") / span))
    rows = rows.withColumn("_block", F.explode(F.array(F.col("_home"), F.col("_home") + 1)))
    w = Window.partitionBy(key, "_block").orderBy("_us").rangeBetween(-(span - 1), 0)
    counted = rows.withColumn(name, F.count(F.lit(1)).over(w))
    return counted.where("_block = _home").drop("_us", "_home", "_block")


def last_rows_mean(df: DataFrame, keys: Sequence[str], order: str, columns: Sequence[str], rows: int = 30) -> DataFrame:
    """Mean of the last ``rows`` rows of each group per column, NULLs left out."""
    w = Window.partitionBy(*keys).orderBy(F.desc(order))
    last = df.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= rows)
    return last.groupBy(*keys).agg(*[F.avg(c).alias(c) for c in columns])


def forecast_with_actuals(forecast: DataFrame, actual: DataFrame, keys: Sequence[str], day: str, expected: str, value: str, rows: int = 14, least: int = 7) -> DataFrame:
    """Every forecast with its actual value: adds ``is_actual`` and ``spread``, the rolling deviation of the residuals.

    Where fewer than ``least`` residuals are known, the spread is the mean of the series' rolling deviations.
    """
    both = forecast.join(actual, [*keys, day], "left").withColumn("is_actual", F.col(value).isNotNull())
    both = both.withColumn("_r", F.col(value) - F.col(expected))
    _, own = rolling(both, keys, day, "_r", rows, least)
    both = both.withColumn("_own", own)
    usual = both.groupBy(*keys).agg(F.avg("_own").alias("_usual"))
    return both.join(usual, list(keys)).withColumn("spread", F.coalesce("_own", "_usual")).drop("_own", "_usual", "_r")


def with_hourly(rows: DataFrame, day: str, hourly: DataFrame, hour_day: str, hour: str, at: int, point: dict[str, str], sums: dict[str, str]) -> DataFrame:
    """Rows of days with the values of one hour and with the sums of all hours of their day; NULL where there are none."""
    one = hourly.where(F.col(hour) == at).select(F.col(hour_day).alias(day), *[F.col(c).alias(n) for c, n in point.items()])
    whole = hourly.groupBy(F.col(hour_day).alias(day)).agg(*[F.sum(c).alias(n) for c, n in sums.items()])
    return rows.join(one, day, "left").join(whole, day, "left")


def filled(df: DataFrame, keys: Sequence[str], order: str, value: str, block: str = "MM") -> DataFrame:
    """NULL values replaced by the last one before them, else by the next one after them.

    Windows run within months; what a month inherits comes from a table with one row per key and month.
    """
    rows = df.withColumn("_block", F.trunc(order, block))
    inside = Window.partitionBy(*keys, "_block").orderBy(order)
    per = rows.where(F.col(value).isNotNull()).groupBy(*keys, "_block").agg(F.max_by(value, order).alias("_last"), F.min_by(value, order).alias("_first"))
    months = rows.select(*keys, "_block").distinct().join(per, [*keys, "_block"], "left")
    w = Window.partitionBy(*keys).orderBy("_block")
    months = months.select(
        *keys, "_block", F.last("_last", True).over(w.rowsBetween(Window.unboundedPreceding, -1)).alias("_before"),
        F.first("_first", True).over(w.rowsBetween(1, Window.unboundedFollowing)).alias("_after"),
    )
    back = F.last(value, True).over(inside.rowsBetween(Window.unboundedPreceding, 0))
    ahead = F.first(value, True).over(inside.rowsBetween(0, Window.unboundedFollowing))
    found = rows.withColumn("_back", back).withColumn("_ahead", ahead).join(months, [*keys, "_block"])
    return found.withColumn(value, F.coalesce("_back", "_before", "_ahead", "_after")).drop("_block", "_back", "_ahead", "_before", "_after")
