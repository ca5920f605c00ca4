"""Numeric and date expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NUMBER = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"
# White space as Unicode defines it, plus the four ASCII separators, at either end of a text.
SPACES = "\t\n\x0b\f\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
MICROS_PER_DAY = 86400 * 1_000_000


def finite(column: Column) -> Column:
    """NaN and null are the same absence."""
    return F.nanvl(column.cast("double"), F.lit(None).cast("double"))


def to_number(column: Column, strip_symbols: bool = False) -> Column:
    """Text to double; anything that is not a plain number becomes null."""
    text = column.cast("string")
    if strip_symbols:
        text = F.translate(text, ",$%", "")
    text = F.btrim(text, F.lit(SPACES))
    return F.when(text.rlike(NUMBER), text.try_cast("double"))


def to_timestamp(column: Column) -> Column:
    """Anything to a UTC timestamp; unparseable text becomes null."""
    return column.try_cast("timestamp")


def non_negative(column: Column) -> Column:
    return F.when(column >= 0, column)


def log1p(column: Column) -> Column:
    return F.when(column >= 0, F.log1p(column))


def clip(column: Column, lower: float = 0.0, upper: float = 1.0) -> Column:
    """Limit to a range; null stays null."""
    return F.when(column < lower, F.lit(lower)).when(column > upper, F.lit(upper)).otherwise(column)


def flag(condition: Column) -> Column:
    """Boolean to 0/1 with null as 0."""
    return F.coalesce(condition, F.lit(False)).cast("int")


def guarded_ratio(numerator: Column, denominator: Column) -> Column:
    return F.when(denominator > 0, numerator.cast("double") / denominator)


def _micros(column: Column) -> Column:
    return F.unix_micros(column.cast("timestamp"))


def whole_days(start: Column, end: Column) -> Column:
    """Floored day difference: one hour before is day -1."""
    return F.floor((_micros(end) - _micros(start)) / F.lit(MICROS_PER_DAY)).cast("long")


def fractional_days(start: Column, end: Column) -> Column:
    return (_micros(end) - _micros(start)) / F.lit(float(MICROS_PER_DAY))


def null_count(*columns: Column) -> Column:
    """How many of the columns are null in this row."""
    total = F.lit(0)
    for column in columns:
        total = total + column.isNull().cast("int")
    return total


def present_count(*columns: Column) -> Column:
    total = F.lit(0)
    for column in columns:
        total = total + column.isNotNull().cast("int")
    return total


def weighted_sum(weights: dict[str, float]) -> Column:
    """Left-to-right weighted sum of named columns, clipped to [0, 1]."""
    total = F.lit(0.0)
    for name, weight in weights.items():
        total = total + F.col(name).cast("double") * F.lit(weight)
    return clip(total)
