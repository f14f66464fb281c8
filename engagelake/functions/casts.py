"""Lenient conversions: bad input becomes a default instead of an error."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

_NUMBER = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"


def _as_number(c: Column, target: str, kind: T.DataType | None) -> Column:
    zero = F.lit(0).cast(target)
    if isinstance(kind, T.NumericType):
        return F.coalesce(c.try_cast(target), zero)
    text = c.cast("string")
    # The pattern keeps out forms the JVM parser takes but a number column should not hold ("1d", "NaN").
    checked = F.when(text.rlike(_NUMBER), text)
    exact = checked.try_cast(target)
    truncated = checked.try_cast("double").try_cast(target)
    return F.coalesce(exact, truncated, zero)


def lenient_int(c: Column, kind: T.DataType | None = None) -> Column:
    """Text or number to int: fractions are cut, anything unreadable or too large is 0.

    A known numeric ``kind`` skips the text parsing.
    """
    return _as_number(c, "int", kind)


def lenient_long(c: Column, kind: T.DataType | None = None) -> Column:
    return _as_number(c, "bigint", kind)


def lenient_bool(c: Column) -> Column:
    """Null or unreadable is false."""
    return F.coalesce(c.try_cast("boolean"), F.lit(False))


def pinned_flag(c: Column) -> Column:
    """true/1/yes in any case, or a number other than zero."""
    text = F.lower(F.trim(c.cast("string")))
    number = F.when(text.rlike(_NUMBER), text.try_cast("double"))
    return F.when(text.isin("true", "1", "yes"), True).otherwise(F.coalesce(number != 0, F.lit(False)))


def zero_if_null(c: Column) -> Column:
    return F.coalesce(c, F.lit(0))


def ratio(numerator: Column, denominator: Column, default: float | None = 0.0) -> Column:
    """Quotient as double; a zero or null denominator gives ``default``."""
    value = numerator.cast("double") / F.nullif(denominator, F.lit(0)).cast("double")
    return value if default is None else F.coalesce(value, F.lit(float(default)))


def round_even(c: Column, digits: int = 2) -> Column:
    """Half-even rounding."""
    return F.bround(c, digits)
