"""Numeric column functions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def money(c: str | Column, precision: int = 18, scale: int = 2) -> Column:
    """A decimal, so that sums do not depend on the order of the rows."""
    return (F.col(c) if isinstance(c, str) else c).cast(f"decimal({precision},{scale})")


def ratio(a: Column, b: Column) -> Column:
    """a / b as double; NULL when b is 0 or NULL."""
    return F.try_divide(a.cast("double"), b.cast("double"))


def percent_change(now: Column, before: Column) -> Column:
    """100 * (now - before) / before; NULL when before is 0 or NULL."""
    return 100.0 * ratio(now - before, before)


def buckets(c: Column, edges: Sequence[float], labels: Sequence[str], right: bool = False, missing: str | None = None) -> Column:
    """Label of the interval that holds ``c``: [a, b), or (a, b] with ``right``. ``labels`` has one more entry than ``edges``."""
    if len(labels) != len(edges) + 1:
        raise ValueError("one more label than edges")
    out = F.when(c.isNull(), F.lit(missing))
    for edge, label in zip(edges, labels):
        out = out.when(c <= edge if right else c < edge, F.lit(label))
    return out.otherwise(F.lit(labels[-1]))


def lookup(c: Column, table: dict, default=None) -> Column:
    """Literal mapping of codes to values; NULL and unknown codes give ``default``."""
    pairs = [F.lit(x) for kv in table.items() for x in kv]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), c), F.lit(default))


def clip(c: Column, low: float | None = None, high: float | None = None) -> Column:
    """c within the limits; NULL stays NULL."""
    out = c
    if low is not None:
        out = F.when(out < low, F.lit(low)).otherwise(out)
    if high is not None:
        out = F.when(out > high, F.lit(high)).otherwise(out)
    return out


def number(c: Column) -> Column:
    """Text to double; what is no number gives NULL."""
    return c.try_cast("double")


def count_differing(columns: Sequence[str], usual: str) -> Column:
    """How many of the columns differ from ``usual``; a NULL counts as differing."""
    return sum((F.when(F.col(c).eqNullSafe(F.lit(usual)), 0).otherwise(1) for c in columns), F.lit(0))


def code_group(code: Column, ranges: Sequence[tuple[float, float, str]], prefixes: Sequence[tuple[str, str]], other: str) -> Column:
    """Group of a classification code: first the prefixes in order, then inclusive numeric ranges, else ``other``.

    Ranges are inclusive on the decimal value. NULL and codes that are neither give ``other``.
    """
    out = F.when(code.isNull(), F.lit(other))
    for prefix, label in prefixes:
        out = out.when(code.startswith(prefix), F.lit(label))
    value = code.try_cast("double")
    for low, high, label in ranges:
        out = out.when((value >= low) & (value <= high), F.lit(label))
    return out.otherwise(F.lit(other))


# The clinical groups of ICD-9 codes, in the order in which they apply.
ICD9_PREFIXES = (("250", "Diabetes"), ("E", "Other"), ("V", "Other"))
ICD9_RANGES = (
    (390, 459, "Circulatory"), (785, 785, "Circulatory"), (460, 519, "Respiratory"), (786, 786, "Respiratory"),
    (520, 579, "Digestive"), (787, 787, "Digestive"), (800, 999, "Injury"), (710, 739, "Musculoskeletal"),
    (580, 629, "Genitourinary"), (788, 788, "Genitourinary"), (140, 239, "Neoplasms"),
)


def icd9_group(code: Column) -> Column:
    return code_group(code, ICD9_RANGES, ICD9_PREFIXES, "Other")


def weather_score(temperature: Column, wind: Column, rain: Column) -> Column:
    """0 to 100: heavy rain 35, light rain 10, cold 25 or 10, wind 20 or 8. NULL adds nothing."""
    wet = F.coalesce(rain, F.lit(0.0))
    return F.least(
        F.lit(100),
        F.when(wet > 5.0, 35).when(wet > 0.1, 10).otherwise(0)
        + F.when(temperature < -10, 25).when(temperature < 0, 10).otherwise(0)
        + F.when(wind > 50, 20).when(wind > 30, 8).otherwise(0),
    )


def half_up(c: Column, digits: int = 0) -> Column:
    """c rounded half up (towards plus infinity) on its double value."""
    scale = 10.0**digits
    return F.floor(c * scale + 0.5) / scale


def merged_maps(*maps: Column) -> Column:
    """One map of all entries; later maps win, but NULL and blank values overwrite nothing."""
    out = None
    for m in maps:
        known = F.map_filter(m, lambda k, v: v.isNotNull() & (F.trim(v.cast("string")) != ""))
        if out is None:
            out = known
        else:
            kept = F.map_filter(out, lambda k, v: ~F.map_contains_key(known, k))  # noqa: B023
            out = F.map_concat(kept, known)
    return out
