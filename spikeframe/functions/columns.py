"""Column expressions: products, contrasts, windows and aggregates that know missing values."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Longest row that is multiplied as an unrolled expression.
UNROLLED = 64
CONTRASTS = ("logcosh", "cube")


def dot(a: str | Column, b: str | Column, size: int | None = None) -> Column:
    """Scalar product of two arrays; of known size it is unrolled and compiled."""
    a, b = (F.col(x) if isinstance(x, str) else x for x in (a, b))
    if size is not None and size <= UNROLLED:
        terms = [F.get(a, F.lit(i)) * F.get(b, F.lit(i)) for i in range(size)]
        total = terms[0]
        for t in terms[1:]:
            total = total + t
        return total
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda acc, v: acc + v)


def contrast_of(col: Column, contrast: str) -> Column:
    if contrast not in CONTRASTS:
        raise ValueError(f"unknown contrast {contrast!r}; one of {', '.join(CONTRASTS)}")
    return F.ln(F.cosh(col)) if contrast == "logcosh" else col * col * col / 6


def hann(size: int) -> list[float]:
    return [0.5 - 0.5 * math.cos(2 * math.pi * n / (size - 1)) for n in range(size)] if size > 1 else [1.0] * size


def valid(col: str | Column) -> Column:
    """NaN as NULL."""
    c = F.col(col) if isinstance(col, str) else col
    return F.when(~F.isnan(c), c)


def lower_median(col: str) -> Column:
    """The lower of the two middle values; NULL as soon as one value is missing."""
    middle = F.expr(f"percentile_disc(0.5) WITHIN GROUP (ORDER BY {col})")
    return F.when(F.count(valid(col)) == F.count(F.lit(1)), middle)


def nan_median(col: str) -> Column:
    """The lower median of the values that are there."""
    return F.expr(f"percentile_disc(0.5) WITHIN GROUP (ORDER BY CASE WHEN NOT isnan({col}) THEN {col} END)")


def nan_sum(col: str) -> Column:
    return F.coalesce(F.sum(valid(col)), F.lit(0.0))
