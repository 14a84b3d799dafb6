"""Numeric helpers shared by reports and profiles."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def ratio(numerator: Column, denominator: Column) -> Column:
    """Division that gives null for a zero denominator."""
    return F.try_divide(numerator, denominator)


def share_percent(part: Column, whole: Column) -> Column:
    """``part / whole * 100`` as a double, in this order of operations."""
    return F.try_divide(part.cast("double"), whole.cast("double")) * F.lit(100.0)


def round_half_up(value: Column) -> Column:
    """Nearest whole number, halves upward."""
    return F.floor(value + F.lit(0.5))


def fixed(value: Column, digits: int, suffix: str = "") -> Column:
    """Fixed-decimal text, null for null."""
    return F.when(value.isNotNull(), F.format_string(f"%.{digits}f{suffix}", value.cast("double")))


def is_numeric(data_type: T.DataType) -> bool:
    return isinstance(data_type, T.NumericType)
