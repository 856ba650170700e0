"""Vector column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SCORE_DIGITS = 6


def _sum(arr: Column) -> Column:
    return F.aggregate(arr, F.lit(0.0).cast("double"), lambda acc, v: acc + v)


def dot(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))


def norm(a: Column) -> Column:
    return F.sqrt(_sum(F.transform(a, lambda x: x.cast("double") * x.cast("double"))))


def cosine(a: Column, b: Column) -> Column:
    """cosine similarity accumulated in double; NULL when either vector has
    zero norm (instead of NaN, which would sort first in a descending order)
    or when the dimensions differ."""
    denom = norm(a) * norm(b)
    same_dim = F.size(a) == F.size(b)
    return F.when(same_dim & (denom != 0), dot(a, b) / denom)


def rounded(score: Column, digits: int = SCORE_DIGITS) -> Column:
    return F.round(score, digits)
