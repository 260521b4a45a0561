"""Small Column helpers."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Minutes per timeframe unit.
UNIT_MINUTES = {"min": 1, "h": 60, "d": 1440, "w": 10080}


def col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def nonzero(x: Column | str) -> Column:
    """The value, or NULL when it is zero; for use as a divisor."""
    return F.nullif(col(x), F.lit(0.0))


def ratio(a: Column | str, b: Column | str) -> Column:
    return col(a) / nonzero(b)


def safe_div(a: Column | str, b: Column | str, fill: float = 0.0) -> Column:
    """a / b, or ``fill`` where the quotient is missing or not finite."""
    quotient = F.try_divide(col(a), col(b))
    return F.when(F.abs(quotient) < F.lit(float("inf")), quotient).otherwise(F.lit(fill))


def finite(x: Column | str) -> Column:
    """NULL for NaN and infinities."""
    x = col(x)
    return F.when(F.abs(x) < F.lit(float("inf")), x)


def clip(x: Column | str, low: float, high: float) -> Column:
    return F.least(F.greatest(col(x), F.lit(low)), F.lit(high))


def ranges_overlap(start_a, end_a, start_b, end_b) -> Column:
    """Do two closed ranges share a point?"""
    return (col(start_a) <= col(end_b)) & (col(start_b) <= col(end_a))


def fixed(x: Column | str, digits: int = 6) -> Column:
    """Rounded for storage or comparison, without a negative zero."""
    return F.round(col(x), digits) + F.lit(0.0)


def timeframe_minutes(text: str) -> int:
    """Minutes of a timeframe such as ``15min``, ``4h``, ``1d`` or ``1w``."""
    found = re.fullmatch(r"(\d+)\s*(min|h|d|w)", text.strip().lower())
    if not found:
        raise ValueError(f"not a timeframe: {text!r}")
    return int(found.group(1)) * UNIT_MINUTES[found.group(2)]
