"""Vector expressions over ``array<double>`` columns. All arithmetic is in double precision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NEAR_ZERO = 1e-10  # fixed value: squared norm below which a vector counts as zero


def _total(products: Column) -> Column:
    return F.aggregate(products, F.lit(0.0), lambda acc, x: acc + x)


def dot(a: Column, b: Column) -> Column:
    return _total(F.zip_with(a, b, lambda x, y: x * y))


def squared_norm(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda acc, x: acc + x * x)


def norm(v: Column) -> Column:
    return F.sqrt(squared_norm(v))


def near_zero(v: Column) -> Column:
    return squared_norm(v) < F.lit(NEAR_ZERO)


def near_zero_exact(v: Column) -> Column:
    """A vector of norm zero has no direction: its similarity to anything is 0."""
    return squared_norm(v) == 0


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; 0 for unequal widths, empty vectors and zero vectors."""
    usable = (F.size(a) == F.size(b)) & (F.size(a) > 0)
    scale = F.sqrt(squared_norm(a) * squared_norm(b))
    return F.when(usable, F.coalesce(F.try_divide(dot(a, b), scale), F.lit(0.0))).otherwise(0.0)


def squared_euclidean(a: Column, b: Column) -> Column:
    return _total(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)))


def euclidean(a: Column, b: Column) -> Column:
    return F.sqrt(squared_euclidean(a, b))


def unit(v: Column) -> Column:
    """``v`` scaled to length one; a zero vector stays zero."""
    # the one-element array binds the norm to a variable, so it is computed once and not per element
    scaled = F.transform(
        F.array(norm(v)), lambda n: F.transform(v, lambda x: F.coalesce(F.try_divide(x, n), F.lit(0.0)))
    )
    return F.element_at(scaled, 1)


def vector_text(v: Column) -> Column:
    """``[a;b;c]``, empty text for a missing vector."""
    return F.coalesce(F.concat(F.lit("["), F.array_join(v.cast("array<string>"), ";"), F.lit("]")), F.lit(""))
