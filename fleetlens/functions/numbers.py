"""Exact rounding of ratios of whole numbers.

A percentage rounded to a tenth is computed in integers, half up. The result does not depend on the
order in which a distributed sum was put together, and exact ties never fall the wrong way.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def rounded_ratio(part: Column, whole: Column, scale: int = 1) -> Column:
    """``round(scale * part / whole)`` as bigint, half up; NULL when ``whole`` is 0 or NULL.

    Meant for non-negative whole numbers.
    """
    part, whole = part.cast("bigint"), F.nullif(whole.cast("bigint"), F.lit(0).cast("bigint"))
    return F.call_function("div", part * F.lit(2 * scale) + whole, whole * F.lit(2))


def percent_tenths(part: Column, whole: Column) -> Column:
    """Share of ``part`` in ``whole`` as a whole number of tenths of a percent (0 to 1000)."""
    return rounded_ratio(part, whole, 1000)


def percent(part: Column, whole: Column) -> Column:
    """Share of ``part`` in ``whole`` in percent, one decimal."""
    return percent_tenths(part, whole) / F.lit(10.0)
