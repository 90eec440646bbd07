"""Functions of numeric arrays."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    zipped = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(zipped, F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; NULL if a vector is NULL or has length 0."""
    return F.try_divide(dot(a, b), norm(a) * norm(b))


def top_classes(probabilities: Column, labels: list[str], k: int) -> Column:
    """The k likeliest labels as structs ``p, label`` in falling order; ties by label."""
    pairs = F.transform(probabilities, lambda p, i: F.struct((-p).alias("n"), F.element_at(F.array(*[F.lit(x) for x in labels]), i + 1).alias("label")))
    return F.transform(F.slice(F.array_sort(pairs), 1, k), lambda x: F.struct((-x["n"]).alias("p"), x["label"].alias("label")))
