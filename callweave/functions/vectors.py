"""Vector expressions over ``array<double>`` columns."""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column
from pyspark.sql import functions as F


def as_vector(column: str | Column) -> Column:
    return F.col(column).cast("array<double>") if isinstance(column, str) else column.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x * x))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; 0 when either norm is 0 or a vector is missing."""
    length = norm(a) * norm(b)
    return F.coalesce(F.when(length == 0, F.lit(0.0)).otherwise(dot(a, b) / length), F.lit(0.0))


def unit(a: Column, epsilon: float = 0.0) -> Column:
    """``a`` over its norm; a zero vector stays as it is."""
    length = norm(a) + F.lit(epsilon)
    return F.when(length == 0, a).otherwise(F.transform(a, lambda x: x / length))


def weighted_sum(terms: list[tuple[float, Column]]) -> Column:
    scaled = [F.transform(vector, _times(weight)) for weight, vector in terms]
    out = scaled[0]
    for vector in scaled[1:]:
        out = F.zip_with(out, vector, lambda x, y: x + y)
    return out


def _times(weight: float):
    return lambda x: x * F.lit(weight)


def mean_vector(column: str | Column) -> Column:
    """Aggregate: the mean vector of a group, combined map-side."""
    return vector_to_array(Summarizer.mean(array_to_vector(as_vector(column))))
