"""Rounding and range helpers on columns."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def half_up(x: Column, digits: int = 4) -> Column:
    """Round half up as plain arithmetic, alike in every engine."""
    k = 10**digits
    return F.floor(x * k + 0.5) / F.lit(k)


def clamp(x: Column, low, high) -> Column:
    """``x`` kept between two bounds, which may be columns."""
    lo = low if isinstance(low, Column) else F.lit(low)
    hi = high if isinstance(high, Column) else F.lit(high)
    return F.least(F.greatest(x, lo), hi)


def to_byte(x: Column) -> Column:
    """An 8-bit sample: clamped to 0..255 and truncated."""
    return F.floor(clamp(x.cast("double"), 0.0, 255.0)).cast("long")


def round_half_up(x: float, digits: int = 4) -> float:
    """The same for a number inside a task."""
    k = 10**digits
    return math.floor(x * k + 0.5) / k
