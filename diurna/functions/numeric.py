"""Numeric expressions: tolerance equality, links, ratios, NaN hygiene."""

from __future__ import annotations

import math
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def nan_to_null(col: Column) -> Column:
    """Missing is NULL: Spark aggregates skip NULL but not NaN."""
    return F.when(F.isnan(col), F.lit(None)).otherwise(col)


def is_finite(col: Column) -> Column:
    """False for NULL, NaN and both infinities."""
    return F.coalesce(
        ~F.isnan(col) & (F.abs(col) < F.lit(float("inf"))), F.lit(False)
    )


def isclose(a: Column, b: Column, rtol: float = 1e-5, atol: float = 1e-8) -> Column:
    """|a - b| <= atol + rtol * |b|."""
    return F.abs(a - b) <= F.lit(atol) + F.lit(rtol) * F.abs(b)


def ratio(numerator: Column, denominator: Column) -> Column:
    """Quotient; NULL where the denominator is 0."""
    return F.try_divide(numerator, denominator)


def scale_age(age: Column) -> Column:
    return (age - F.lit(9.0)) / F.lit(2.0)


def logistic_range(x: Column, low: float, high: float) -> Column:
    """Open-interval link: low + (high - low) * sigmoid(x)."""
    return F.lit(low) + F.lit(high - low) / (F.lit(1.0) + F.exp(-x))


def linear_score(weights: Mapping[str, float], intercept: float = 0.0) -> Column:
    """Weighted column sum, added up in mapping order."""
    total = F.lit(float(intercept))
    for name, weight in weights.items():
        total = total + F.lit(float(weight)) * F.col(name)
    return total


def log_linear_mean(weights: Mapping[str, float], base: float, gain: float) -> Column:
    """exp(ln(base) + gain * score): the mean on the natural scale."""
    return F.exp(F.lit(math.log(base)) + F.lit(gain) * linear_score(weights))


def band(col: Column, width: float) -> Column:
    """Nearest multiple of ``width``, halves to even."""
    return F.rint(col / F.lit(float(width))) * F.lit(float(width))


def r6(col: Column) -> Column:
    """Six decimals, the precision results are compared at."""
    return F.round(col.cast("double"), 6)
