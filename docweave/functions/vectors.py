"""Column expressions over vectors held as arrays (VEC6)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _doubles(v: Column | str) -> Column:
    return (F.col(v) if isinstance(v, str) else v).cast("array<double>")


def dot(a: Column | str, b: Column | str) -> Column:
    """Inner product of two arrays of numbers."""
    return F.aggregate(F.zip_with(_doubles(a), _doubles(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column | str) -> Column:
    return F.sqrt(F.aggregate(_doubles(a), F.lit(0.0), lambda s, x: s + x * x))


def clipped(dot_: Column, norm_a: Column, norm_b: Column) -> Column:
    """Cosine from a product and two norms: within [-1, 1], 0 for a zero vector or a value that is no number."""
    raw = F.try_divide(dot_, norm_a * norm_b)
    return F.when(raw.isNull() | F.isnan(raw), 0.0).otherwise(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), raw)))


def cosine(a: Column | str, b: Column | str) -> Column:
    """Cosine of two vectors; unequal lengths are an error."""
    a, b = _doubles(a), _doubles(b)
    same = F.assert_true(F.size(a) == F.size(b), F.lit("vectors differ in length"))
    return F.when(same.isNull(), clipped(dot(a, b), norm(a), norm(b)))


def from_text(v: Column | str) -> Column:
    """A vector given as JSON text."""
    return F.from_json(v, "array<double>")
