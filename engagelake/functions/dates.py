"""Time conversions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DEFAULT_ZONE = "America/Sao_Paulo"

# Weekday names, Monday first.
WEEKDAYS_PT = [
    "Segunda-feira",
    "Terça-feira",
    "Quarta-feira",
    "Quinta-feira",
    "Sexta-feira",
    "Sábado",
    "Domingo",
]


def local_time(c: Column, zone: str = DEFAULT_ZONE) -> Column:
    """ISO text to wall-clock time in ``zone`` (no zone attached); unreadable text is null.

    Counts on the UTC session zone that ``engagelake.session`` sets.
    """
    return F.from_utc_timestamp(F.try_to_timestamp(c.cast("string")), zone).cast("timestamp_ntz")


def whole_days(start: Column, end: Column) -> Column:
    """Full 24-hour spans between two times (23:00 to next day 01:00 is 0)."""
    return F.timestamp_diff("DAY", start, end)


def weekday_index(c: Column) -> Column:
    """Monday = 0."""
    return F.weekday(c)


def weekday_name(c: Column) -> Column:
    return F.element_at(F.array(*[F.lit(d) for d in WEEKDAYS_PT]), F.weekday(c) + 1)
