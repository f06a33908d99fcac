"""Arithmetic and truth rules of the recorded logs' producers, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def half_up(x: Column, digits: int = 0) -> Column:
    """Rounding with halves toward +infinity, -2.5 to -2 (Spark's round gives -3)."""
    scale = 10**digits
    return F.floor(x * scale + F.lit(0.5)).cast("double") / scale if digits else F.floor(x + F.lit(0.5)).cast("long")


def or_else(x: Column, default) -> Column:
    """``default`` where x is null, zero or empty."""
    empty = x.isNull() | (x.cast("string").isin("", "0", "0.0"))
    return F.when(empty, F.lit(default)).otherwise(x)


def is_false(x: Column) -> Column:
    """True only for an explicit false; null (still open) is not false."""
    return F.coalesce(~x, F.lit(False))


def is_true(x: Column) -> Column:
    return F.coalesce(x, F.lit(False))


def day(ms: Column) -> Column:
    """UTC day of epoch milliseconds, as YYYY-MM-DD."""
    return F.date_format(F.timestamp_millis(ms), "yyyy-MM-dd")


def share_percent(part: Column, whole: Column) -> Column:
    """Percentage with one decimal; 0 of nothing."""
    return F.when(whole > 0, half_up(part * 1000.0 / whole) / F.lit(10.0)).otherwise(0.0)


def to_fixed(x: Column, digits: int) -> Column:
    """A number that is not negative, with ``digits`` decimals: by its exact value, ties up (the fraction is exact)."""
    scale = 10**digits
    part = F.floor((x - F.floor(x)) * scale + 0.5)
    return F.concat((F.floor(x) + F.when(part >= scale, 1).otherwise(0)).cast("string"), F.lit("."), F.lpad((part % scale).cast("string"), digits, "0"))
