"""Exact rounding of ratios of whole numbers, half away from zero, as whole numbers of the last digit."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def rounded_ratio(numerator: Column, denominator: Column, scale: int) -> Column:
    """round(numerator / denominator * scale) for a non-negative denominator; null if that is 0 or null."""
    n, d = numerator.cast("bigint"), F.nullif(denominator.cast("bigint"), F.lit(0))
    return F.call_function("div", F.abs(n) * (2 * scale) + d, d * 2) * F.signum(n).cast("bigint")


def tenths(points: Column, possessions: Column) -> Column:
    """Points per 100 possessions in tenths."""
    return rounded_ratio(points, possessions, 1000)
