"""Vector algebra as Column expressions over ``array<double>``.

A vector that is null or empty, holds a null or non-finite component, or whose
norm is at most ``LEAST_NORM`` has no direction: ``unit`` of it is null, and
``require_unit`` raises.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

LEAST_NORM = 1e-12


def as_double(v: Column | str) -> Column:
    return (F.col(v) if isinstance(v, str) else v).cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))


def has_direction(v: Column, length: Column) -> Column:
    """Whether a vector of that norm can be normalised."""
    finite = ~F.isnan(length) & (length != float("inf"))
    return F.coalesce((F.size(v) > 0) & finite & (length > LEAST_NORM), F.lit(False))


def scaled(v: Column, length: Column) -> Column:
    return F.transform(v, lambda x: x / length)


def with_unit(df, source: str, target: str, strict: bool = False):
    """``df`` with ``target``: the unit vector of ``source``; null, or an error if ``strict``, without a direction."""
    length = "_length"
    base = df.withColumn(target, as_double(source)).withColumn(length, norm(F.col(target)))
    good = has_direction(F.col(target), F.col(length))
    none = F.raise_error(F.lit("a vector without a direction can't be scaled")).cast("array<double>") if strict else F.lit(None)
    return base.withColumn(target, F.when(good, scaled(F.col(target), F.col(length))).otherwise(none)).drop(length)


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / (norm(a) * norm(b))


def cosine_distance(a: Column, b: Column) -> Column:
    return F.lit(1.0) - cosine(a, b)


def mean_vector(v: str) -> Column:
    """Column-wise mean of the group's vectors, by Spark's vector summarizer (partial sums before the shuffle)."""
    from pyspark.ml.functions import array_to_vector, vector_to_array
    from pyspark.ml.stat import Summarizer

    return vector_to_array(Summarizer.mean(array_to_vector(F.col(v))))


def shown(x: Column, places: int = 6) -> Column:
    """Rounded for output, without a negative zero."""
    return F.round(x, places) + F.lit(0.0)


def shown_vector(v: Column, places: int = 6) -> Column:
    return F.transform(v, lambda x: F.round(x, places) + F.lit(0.0))
