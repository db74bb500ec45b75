"""Calendar and elapsed-time expressions over zone-less timestamps."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

_MICROS_PER_HOUR = 3_600_000_000
_MICROS_PER_DAY = 24 * _MICROS_PER_HOUR


def _floored(start: Column, end: Column, unit_micros: int) -> Column:
    return F.floor(F.timestamp_diff("MICROSECOND", start, end) / F.lit(unit_micros))


def elapsed_hours(start: Column, end: Column) -> Column:
    """Whole hours from start to end, rounded toward minus infinity (``timestampdiff(HOUR)`` rounds toward 0)."""
    return _floored(start, end, _MICROS_PER_HOUR)


def elapsed_days(start: Column, end: Column) -> Column:
    """Whole days, rounded toward minus infinity: five hours earlier is day -1."""
    return _floored(start, end, _MICROS_PER_DAY)


def hour_boundaries(start: Column, end: Column) -> Column:
    """Number of full-hour marks crossed, which is not the elapsed time in hours."""
    hour = lambda c: F.date_trunc("HOUR", c).cast("timestamp_ntz")
    return F.timestamp_diff("HOUR", hour(start), hour(end))


def age_at(when: Column, born: Column) -> Column:
    """Calendar age, one less before the birthday in that year and 0 before birth."""
    day_of_year = lambda c: F.month(c) * 100 + F.dayofmonth(c)
    before_birthday = (day_of_year(when) < day_of_year(born)).cast("int")
    return F.when(when < born, F.lit(0)).otherwise(F.year(when) - F.year(born) - before_birthday).cast("int")


def within(moment: Column, start: Column, end: Column) -> Column:
    """Inclusive containment; an unknown time is outside."""
    return F.coalesce(moment.between(start, end), F.lit(False))
