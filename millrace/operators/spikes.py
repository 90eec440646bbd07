"""Readings that a source cannot have had or that are far out of its normal behaviour (problem 1)."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.operators.scan import with_position
from millrace.runtime import cut


@dataclass(frozen=True)
class Fences:
    """Parameters of ``flag_readings``.

    frozen: this many equal consecutive readings or more are a frozen run. fence: width of the fences
    in interquartile ranges, less what mere counting of so few makes up of them; counted: width of the
    fences for that part, in square roots of the expected reading. raised: a reading this many times its
    neighbours, and beyond the fence of the source's calm days, is a raised one. habit: from this share of raised readings on, raised days are a
    habit of the source, and what lies within the fence of its raised readings is normal.
    around: readings looked at on either side. accuracy: of the quantile sketches.
    """

    frozen: int = 5
    fence: float = 4.0
    counted: float = 4.5
    habit: float = 0.07
    raised: float = 1.3
    around: int = 12
    least_around: int = 3
    block: int = 512
    accuracy: int = 2000


def readings(df: DataFrame, source: str, day: str, value: str, context: str, version: str) -> DataFrame:
    """One row per source and day: ``source, month, day, value, context``, laid out by source and month.

    The latest delivery counts. A missing context (kind of day) is taken from what most sources state
    for that day; if none does, from the weekday. NULL values are no readings; rows without source or
    day belong to no series. All of these are left out.
    """
    rows = df.select(
        F.col(source).cast("string").alias("source"), F.col(day).cast("date").alias("day"),
        F.col(value).cast("double").alias("value"), F.upper(F.trim(F.col(context))).alias("context"), F.col(version).alias("version"),
    ).where("source IS NOT NULL AND day IS NOT NULL")
    days = (
        rows.where("context IS NOT NULL").groupBy("day", "context").agg(F.count(F.lit(1)).alias("n"))
        .groupBy("day").agg(F.max_by("context", F.struct("n", "context")).alias("stated"))
    )
    weekday = F.when(F.weekday("day") == 5, "A").when(F.weekday("day") == 6, "U").otherwise("W")
    once = (
        rows.where("value IS NOT NULL AND NOT isnan(value)").withColumn("month", F.trunc("day", "MM")).repartition("source", "month")
        .groupBy("source", "month", "day")
        .agg(F.max_by("value", F.struct("version", "value")).alias("value"), F.max("context").alias("own"))
    )
    # One row per calendar day, whatever the number of sources.
    return once.join(F.broadcast(days), "day", "left").select(
        "source", "month", "day", "value", F.coalesce("own", "stated", weekday).alias("context")
    )


def _median(values: Column, least: int) -> Column:
    """Median of an array, NULL if it has fewer than ``least`` values."""
    s, n = F.array_sort(values), F.size(values)
    low, high = F.floor((n - 1) / 2).cast("int"), F.floor(n / 2).cast("int")
    return F.when(n >= least, (F.get(s, low) + F.get(s, high)) / 2)


def _blocks(rows: DataFrame, size: int, halo: int) -> DataFrame:
    """Rows numbered ``at`` in blocks of ``size``, each with ``halo`` rows of its neighbours (``own`` is false there)."""
    home = F.floor(F.col("at") / size)
    inside = F.pmod("at", F.lit(size))
    where = F.array_compact(
        F.array(home, F.when((inside < halo) & (home > 0), home - 1), F.when(inside >= size - halo, home + 1))
    )
    return rows.withColumn("home", home).withColumn("block", F.explode(where)).withColumn("own", F.col("block") == F.col("home"))


def flag_readings(
    df: DataFrame, source: str, day: str, value: str, context: str, version: str, settings: Fences = Fences()
) -> DataFrame:
    """Every reading with what speaks against it: ``source, day, value, context, level, change, reasons``.

    ``reasons`` is empty for a good reading and otherwise holds one or more of

    * ``impossible``: below zero;
    * ``frozen``: one of a run of equal consecutive readings (zero variance);
    * ``high``, ``low``: outside the fences of its source and kind of day *and* an implausible change
      against both the readings before and those after it.

    Quantile sketches (mergeable, one per source and kind of day; partial sketches are formed before
    the shuffle) give the source's level on such days. Readings are divided by it, which makes working
    days and holidays comparable, and compared with the median of their neighbours on either side;
    the smaller of the two changes counts. So a lasting change of level, which agrees with one of its
    sides, is none. A second set of sketches of these changes, per source and kind of day and per source, gives the
    interquartile fences (the wider of the two counts, so a kind of day with few readings is not held to a
    range that came out small by chance). Sources with a habit of busy days get a third sketch, of their raised
    readings, and its fence. Levels below 1 count as 1, so a source that is mostly idle has fences too.

    Neighbours are found in blocks of consecutive readings with a margin; no source is held by one
    task. Sources with fewer readings than ``least_around`` on both sides can only be impossible or frozen.
    """
    s = settings
    rows = with_position(readings(df, source, day, value, context, version), ["source"], "month", ["day"], "at").drop("month")
    rows = cut(rows)
    # What is known of a source is repeated for each of its blocks, so that it meets the readings where they lie.
    blocks = rows.groupBy("source").agg(F.max("at").alias("n")).select("source", F.explode(F.sequence(F.lit(0), F.floor(F.col("n") / s.block))).alias("block"))
    meet = lambda part, known: part.join(blocks.join(known, "source"), ["source", "block"], "left")
    halo = s.around + s.frozen
    w = Window.partitionBy("source", "block").orderBy("at")
    parts = _blocks(rows, s.block, halo)
    starts = F.when(F.lag("value").over(w) == F.col("value"), 0).otherwise(1)
    parts = parts.withColumn("run", F.sum(starts).over(w))
    parts = parts.withColumn("frozen", F.count(F.lit(1)).over(Window.partitionBy("source", "block", "run")) >= s.frozen)

    usable = (F.col("value") >= 0) & ~F.col("frozen")
    level = parts.where(F.col("own") & usable).groupBy("source", "context").agg(
        F.percentile_approx("value", 0.5, F.lit(s.accuracy)).alias("level")
    )
    level = level.groupBy("source").agg(F.map_from_entries(F.collect_list(F.struct("context", "level"))).alias("levels"))
    z = F.when(usable, F.log(F.greatest(F.col("value"), F.lit(1.0)) / F.greatest(F.col("level"), F.lit(1.0))))
    parts = meet(parts, level).withColumn("level", F.try_element_at("levels", F.col("context"))).drop("levels").withColumn("z", z)
    past = F.collect_list("z").over(w.rowsBetween(-s.around, -1))
    coming = F.collect_list("z").over(w.rowsBetween(1, s.around))
    seen = parts.withColumn("past", _median(past, s.least_around)).withColumn("coming", _median(coming, s.least_around)).where("own")
    up = F.col("z") - F.coalesce("past", "coming")
    down = F.col("z") - F.coalesce("coming", "past")
    change = F.when(F.signum(up) != F.signum(down), 0.0).otherwise(F.when(F.abs(up) < F.abs(down), up).otherwise(down))
    seen = cut(
        seen.select("source", "block", "day", "value", "context", "level", "frozen", ((up + down) / 2).alias("both"), change.alias("change"))
    )
    quartiles = lambda c: F.percentile_approx(c, F.array(F.lit(0.25), F.lit(0.75)), F.lit(s.accuracy))
    width = lambda q: q[1] - q[0]
    usual = seen.groupBy("source", "context").agg(quartiles("both").alias("q"))
    usual = usual.groupBy("source").agg(F.map_from_entries(F.collect_list(F.struct("context", width(F.col("q")).alias("q")))).alias("usual"))
    calm = seen.groupBy("source").agg(quartiles(F.when(F.col("change") <= math.log(s.raised), F.col("both"))).alias("calm"))
    ranged = meet(seen, usual.join(calm.select("source", width(F.col("calm")).alias("calm")), "source"))
    raised = F.col("change") > F.greatest(F.lit(math.log(s.raised)), s.fence * F.col("calm"))
    habits = (
        ranged.groupBy("source")
        .agg(quartiles(F.when(raised, F.col("change"))).alias("busy"), F.try_divide(F.count_if(raised), F.count("change")).alias("share"))
        .where(F.col("share") >= s.habit)
        .select("source", (F.col("busy")[1] + 1.5 * (F.col("busy")[1] - F.col("busy")[0])).alias("busy_to"))
    )
    spread = F.greatest(F.try_element_at("usual", F.col("context")), F.col("calm"))
    root = F.sqrt(F.greatest(F.greatest("value", F.lit(1.0)) / F.exp("change"), F.lit(1.0)))
    beyond = F.lit(s.fence) * F.sqrt(F.greatest(spread * spread - (1.35 / root) * (1.35 / root), F.lit(0.0)))
    both = lambda x: F.sqrt(beyond * beyond + x * x)
    high = F.greatest(both(F.log(1 + s.counted / root)), F.coalesce("busy_to", F.lit(0.0)))
    low = both(F.log(F.greatest(1 - s.counted / root, F.lit(0.02))))
    reasons = F.array_compact(
        F.array(
            F.when(F.col("value") < 0, "impossible"),
            F.when(F.col("frozen"), "frozen"),
            F.when(F.col("change") > high, "high"),
            F.when(F.col("change") < -low, "low"),
        )
    )
    return (
        meet(ranged, habits)
        .select("source", "day", "value", "context", "level", "change", reasons.alias("reasons"))
    )
