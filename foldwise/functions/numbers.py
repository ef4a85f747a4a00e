"""Scalar expressions: missing and finite tests, clipping, safe casts, bins, display text."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

INFINITY = float("inf")


def to_column(value) -> Column:
    return F.col(value) if isinstance(value, str) else value


def as_double(value) -> Column:
    """Numeric coercion that gives null for text that is no number."""
    return to_column(value).try_cast("double")


def is_missing(value) -> Column:
    """Null or NaN: the two forms of a missing number."""
    number = as_double(value)
    return number.isNull() | F.isnan(number)


def is_finite(value) -> Column:
    number = as_double(value)
    return number.isNotNull() & ~F.isnan(number) & (F.abs(number) < F.lit(INFINITY))


def safe_float(value, default: float = 0.0) -> Column:
    """A finite double, or the default where the value cannot be read as one."""
    return F.when(is_finite(value), as_double(value)).otherwise(F.lit(float(default)))


def clip(value, low, high) -> Column:
    """Limit a number to [low, high]; null and NaN pass through unchanged."""
    number = to_column(value)
    low = low if isinstance(low, Column) else F.lit(float(low))
    high = high if isinstance(high, Column) else F.lit(float(high))
    return F.when(F.isnan(number), number).when(number < low, low).when(number > high, high).otherwise(number)


def one_hot(value, choices) -> Column:
    """0/1 array with one slot per choice and a last slot for any other value."""
    column = to_column(value)
    slots = [F.coalesce(column == F.lit(choice), F.lit(False)).cast("int") for choice in choices]
    known = reduce(lambda a, b: a + b, slots)
    return F.array(*slots, F.lit(1) - known)


def display_text(value, decimals: int = 3) -> Column:
    """Fixed-decimal text, as printed in a report."""
    return F.format_string(f"%.{int(decimals)}f", to_column(value))


def bin_index(value, edges) -> Column:
    """Right-closed bin of a number; the lowest edge belongs to bin 0, the highest to the last bin, a missing number to none.

    Written as a sum of comparisons so that it stays inside generated code.
    """
    edges = [float(edge) for edge in edges]
    number = to_column(value)
    if len(edges) < 2:
        return F.when(~is_missing(number), F.lit(0))
    above = reduce(lambda a, b: a + b, [(number > F.lit(edge)).cast("int") for edge in edges])
    return F.when(~is_missing(number), F.least(F.lit(len(edges) - 2), F.greatest(F.lit(0), above - 1)))


def seed_schedule(base, fold, multiplier: int, offset: int = 0) -> Column:
    """Seed of one (member, fold) unit: base + multiplier * fold + offset."""
    return to_column(base) + to_column(fold) * F.lit(int(multiplier)) + F.lit(int(offset))


def rounded(value, decimals: int = 6) -> Column:
    """Rounded double without a negative zero."""
    return F.round(to_column(value), decimals) + F.lit(0.0)
