"""Array-column arithmetic on embeddings."""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column
from pyspark.sql import functions as F

# Smallest norm used as a divisor: the single-precision machine epsilon.
NORM_FLOOR = 1.1920928955078125e-07


def doubles(v: Column) -> Column:
    return v.cast("array<double>")


def total(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda acc, x: acc + x)


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(doubles(a), doubles(b), lambda x, y: x * y))


def norm(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def unit(v: Column) -> Column:
    length = F.greatest(norm(v), F.lit(NORM_FLOOR))
    return F.transform(doubles(v), lambda x: x / length)


def cosine_distance(a: Column, b: Column) -> Column:
    similarity = dot(a, b) / (
        F.greatest(norm(a), F.lit(NORM_FLOOR)) * F.greatest(norm(b), F.lit(NORM_FLOOR))
    )
    return F.least(F.greatest(1.0 - similarity, F.lit(0.0)), F.lit(2.0))


def sq_l2(a: Column, b: Column) -> Column:
    return total(F.zip_with(doubles(a), doubles(b), lambda x, y: (x - y) * (x - y)))


def blend(d_embedding: Column, d_color: Column, weight: float) -> Column:
    """Weighted mean of two distances; weight 0 leaves the embedding distance alone."""
    if weight == 0:
        return d_embedding
    return (d_embedding + weight * d_color) / (1.0 + weight)


def mean_vector(name: str, weight: str | None = None) -> Column:
    """Element-wise (weighted) mean of an array column: an aggregate with one vector per group as state."""
    values = array_to_vector(doubles(F.col(name)))
    mean = Summarizer.mean(values) if weight is None else Summarizer.mean(values, F.col(weight))
    return vector_to_array(mean)
