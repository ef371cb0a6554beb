"""Column functions over arrays of numbers."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def dot(a: Column, b: Column) -> Column:
    """Inner product in double precision, element by element in order."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def l2_normalised(v: Column) -> Column:
    """v over its length; a zero vector stays as it is."""
    return F.when(norm(v) > 0, F.transform(v, lambda x: x.cast("double") / norm(v))).otherwise(v.cast("array<double>"))


def masked_mean(vectors: Column, mask: Column) -> Column:
    """Mean of the token vectors whose mask is 1; zeros if there is none."""
    kept = F.filter(F.arrays_zip(vectors.alias("v"), mask.alias("m")), lambda x: x["m"] == 1)
    size = F.greatest(F.size(kept), F.lit(1))
    zero = F.transform(F.get(vectors, F.lit(0)), lambda _: F.lit(0.0))
    total = F.aggregate(kept, zero, lambda s, x: F.zip_with(s, x["v"], lambda a, b: a + b.cast("double")))
    return F.transform(total, lambda x: x / size)


def vector_problem(v: Column, dimension: int, tolerance: float = 1e-3) -> Column:
    """Null for a usable vector, else dimension, finite or norm."""
    real = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))))
    return F.when(v.isNull() | (F.size(v) != dimension), "dimension").when(~real, "finite").when(F.abs(norm(v) - 1) > tolerance, "norm")


def parsed_score(score: Column) -> Column:
    return F.coalesce(score.try_cast("double"), F.lit(0.0))
