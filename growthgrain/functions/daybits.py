"""Sets of days as bits: the active days of a 64-day stretch in one number.

A profile that is active on most days has one row per stretch instead of one per day,
and merging two sets is one ``bit_or``, which Spark applies before it shuffles.
"""

from pyspark.sql import Column
from pyspark.sql import functions as F

STRETCH = 64  # bits of a bigint
_SHIFT = 6  # log2(STRETCH)


def stretch_of(day: Column) -> Column:
    """Number of the stretch a date is in; stretches are counted from 1970-01-01."""
    return F.shiftright(F.unix_date(day), _SHIFT)


def bit_of(day: Column) -> Column:
    """The date as a set of one day within its stretch."""
    place = F.unix_date(day).bitwiseAND(F.lit(STRETCH - 1))
    return F.call_function("shiftleft", F.lit(1).cast("bigint"), place)


def first_day(stretch: Column, start: Column) -> Column:
    """Days from the date ``start`` to the first day of a stretch; may be negative."""
    return F.shiftleft(stretch, _SHIFT) - F.unix_date(start)


def days_between(days: Column, first: Column, low: Column, high: Column) -> Column:
    """The part of a set from day ``low`` to day ``high``, if its first bit is day ``first``."""
    from_bit = F.greatest(low - first, F.lit(0))
    to_bit = F.least(high - first, F.lit(STRETCH - 1))
    every = F.lit(-1).cast("bigint")
    wanted = F.call_function("shiftleft", every, from_bit).bitwiseAND(
        F.call_function("shiftrightunsigned", every, F.lit(STRETCH - 1) - to_bit)
    )
    return F.when(from_bit <= to_bit, days.bitwiseAND(wanted)).otherwise(F.lit(0).cast("bigint"))
