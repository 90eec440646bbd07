"""Rules on rows: contracts, splits into valid and rejected rows, and tests that return what violates them."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.text import json_object
from millrace.operators.stats import percentiles


@dataclass(frozen=True)
class Rule:
    """A named condition that a good row meets. A condition that is NULL is not met."""

    name: str
    condition: Column


def required(c: str) -> Rule:
    return Rule(f"{c}: missing", F.col(c).isNotNull())


def positive(c: str) -> Rule:
    return Rule(f"{c}: not positive", F.col(c).isNull() | (F.col(c) > 0))


def between(c: str, low, high) -> Rule:
    return Rule(f"{c}: out of range", F.col(c).isNull() | F.col(c).between(low, high))


def length_between(c: str, low: int, high: int) -> Rule:
    return Rule(f"{c}: bad length", F.col(c).isNull() | F.length(c).between(low, high))


def one_of(c: str, values: Sequence) -> Rule:
    return Rule(f"{c}: unknown value", F.col(c).isNull() | F.col(c).isin(list(values)))


def matching(c: str, pattern: str) -> Rule:
    return Rule(f"{c}: bad format", F.col(c).isNull() | F.col(c).rlike(pattern))


def castable(c: str, kind: str) -> Rule:
    return Rule(f"{c}: not {kind}", F.col(c).isNull() | F.col(c).try_cast(kind).isNotNull())


def only_keys(c: str, keys: Sequence[str]) -> Rule:
    """A JSON object in a text column has no other keys."""
    extra = F.size(F.array_except(F.json_object_keys(F.col(c)), F.array(*[F.lit(k) for k in keys])))
    return Rule(f"{c}: additional keys", F.col(c).isNull() | (extra == 0))


def errors(rules: Sequence[Rule]) -> Column:
    """Names of the rules that a row breaks, in the order of the rules."""
    return F.array_compact(F.array(*[F.when(~F.coalesce(r.condition, F.lit(False)), F.lit(r.name)) for r in rules]))


def validate(df: DataFrame, rules: Sequence[Rule], name: str = "validation_errors") -> DataFrame:
    """Add the broken rules of every row (an empty array if none)."""
    return df.withColumn(name, errors(rules))


def split(df: DataFrame, rules: Sequence[Rule]) -> tuple[DataFrame, DataFrame]:
    """Valid rows, and rejected rows with ``validation_errors`` joined by semicolons."""
    checked = validate(df, rules)
    bad = F.size("validation_errors") > 0
    rejected = checked.where(bad).withColumn("validation_errors", F.concat_ws("; ", "validation_errors"))
    return checked.where(~bad).drop("validation_errors"), rejected


def violations(df: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """Broken rules and how often, in one pass: ``rule, rows``; rules without violations have 0."""
    one = df.agg(*[F.count_if(~F.coalesce(r.condition, F.lit(False))).alias(f"r{i}") for i, r in enumerate(rules)])
    pairs = F.array(*[F.struct(F.lit(r.name).alias("rule"), F.col(f"r{i}").alias("rows")) for i, r in enumerate(rules)])
    return one.select(F.explode(pairs).alias("x")).select("x.*")


def enforce(df: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """The same rows; reading a row that breaks a rule raises with the rule's name."""
    e = errors(rules)
    ok = F.when(F.size(e) > 0, F.raise_error(F.concat(F.lit("contract broken: "), F.concat_ws("; ", e))).cast("boolean")).otherwise(F.lit(True))
    return df.where(ok)


def require_columns(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df


def not_unique(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys that occur more than once: ``keys, n``."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def conditional_nulls(df: DataFrame, when: Column, column: str) -> DataFrame:
    """Rows that meet ``when`` but lack ``column``."""
    return df.where(when & F.col(column).isNull())


def flatten(df: DataFrame, column: str) -> DataFrame:
    """Replace a struct by its fields, named ``column_field``."""
    fields = df.schema[column].dataType.names
    rest = [c for c in df.columns if c != column]
    return df.select(*rest, *[F.col(f"{column}.{f}").alias(f"{column}_{f}") for f in fields])


# Conditions as data -----------------------------------------------------------------------------
OPERATORS = {
    "eq": lambda c, v: c == v,
    "ne": lambda c, v: c != v,
    "lt": lambda c, v: c < v,
    "le": lambda c, v: c <= v,
    "gt": lambda c, v: c > v,
    "ge": lambda c, v: c >= v,
    "in": lambda c, v: c.isin(list(v)),
    "exists": lambda c, v: c.isNotNull(),
}


def condition(spec: Mapping) -> Column:
    """Compile ``{"field", "op", "value"}`` into three-valued logic: a missing field gives NULL (except for ``exists``)."""
    return OPERATORS[spec["op"]](F.col(spec["field"]), spec.get("value"))


def judge(conditions: Sequence[Mapping]) -> Column:
    """Struct of arrays ``met, failed, missing`` with the names of the conditions."""
    parts = {"met": [], "failed": [], "missing": []}
    for c in conditions:
        told, name = condition(c), F.lit(c.get("name", c["field"]))
        parts["met"].append(F.when(told, name))
        parts["failed"].append(F.when(~told, name))
        parts["missing"].append(F.when(told.isNull(), name))
    return F.struct(*[F.array_compact(F.array(*v)).alias(k) for k, v in parts.items()])


def json_schema(c: str, types: Mapping[str, str], required: Sequence[str] = (), additional: bool = True) -> list[Rule]:
    """Rules of a schema of JSON objects in a text column: fields that must be there, castable types, no other fields."""
    field = lambda f: F.get_json_object(F.col(c), f"$.{f}")
    rules = [Rule(f"{f}: missing", field(f).isNotNull()) for f in required]
    rules += [Rule(f"{f}: not {t}", field(f).isNull() | field(f).try_cast(t).isNotNull()) for f, t in types.items()]
    return rules if additional else [*rules, only_keys(c, list(types))]


def checked_object(said: Column, schema: str, rules: Sequence[tuple[str, Callable[[Column], Column]]]) -> Column:
    """The object in a model's answer as ``struct(success, error, data)``; it never raises."""
    found = json_object(said)
    data = F.from_json(found, schema)
    broken = F.array_compact(F.array(*[F.when(~F.coalesce(test(data), F.lit(False)), F.lit(name)) for name, test in rules]))
    error = F.when(found.isNull(), F.lit("no object")).when(F.size(broken) > 0, F.concat_ws("; ", broken))
    return F.struct(error.isNull().alias("success"), error.alias("error"), F.when(error.isNull(), data).alias("data"))


def feature_values(df: DataFrame, column: str, features: Sequence[str]) -> DataFrame:
    """The features of a struct as rows ``feature, value``; what is no number is skipped."""
    pairs = F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f"{column}.{f}").try_cast("double").alias("value")) for f in features])
    return df.select(F.explode(pairs).alias("x")).select("x.*").where("value IS NOT NULL")


def measurement_flags(df: DataFrame, keys: Sequence[str], day: str, value: str, fence: float = 3.0) -> DataFrame:
    """Rows that are ``negative``, an ``outlier`` of their series' quartile fences or ``ambiguous`` (several values for a day)."""
    q = percentiles(df, keys, value, [0.25, 0.75])
    n = df.groupBy(*keys, day).agg(F.count(F.lit(1)).alias("_n"))
    a, b = F.col("percentiles")[0], F.col("percentiles")[1]
    x = F.col(value)
    out = df.join(q, list(keys)).join(n, [*keys, day]).withColumns(
        {"negative": x < 0, "outlier": (x < a - fence * (b - a)) | (x > b + fence * (b - a)), "ambiguous": F.col("_n") > 1}
    )
    return out.where("negative OR outlier OR ambiguous").drop("percentiles", "_n")
