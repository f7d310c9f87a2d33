"""Functions of dense vectors."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two vectors; 0.0 for empty, zero or unlike-sized ones."""
    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    value = F.when(norms > 0, dot(a, b) / norms).otherwise(F.lit(0.0))
    return F.when((F.size(a) == F.size(b)) & (F.size(a) > 0), value).otherwise(F.lit(0.0))


def squared_distance(a: Column, b: Column) -> Column:
    """Squared Euclidean distance of float vectors, summed in double; null if sizes differ."""
    def square(x: Column, y: Column) -> Column:
        d = x.cast("double") - y.cast("double")
        return d * d

    return F.aggregate(F.zip_with(a, b, square), F.lit(0.0), lambda s, x: s + x)
