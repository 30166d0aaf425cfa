"""Row expressions."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Amounts up to 1e20 USD with nine decimals; their sums hold up to 1e29 USD.
MONEY = "decimal(29,9)"
LAST_LIFECYCLE_WEEK = 12
LAST_LIFECYCLE_DAY = 7 * LAST_LIFECYCLE_WEEK + 6  # 90, also the end of the LTV window


def safe_ratio(numerator: Column, denominator: Column, default: float | None = 0.0) -> Column:
    """``numerator / denominator`` where the denominator is positive, else ``default``."""
    return F.when(denominator > 0, numerator / denominator).otherwise(F.lit(default).cast("double"))


def money(amount: Column) -> Column:
    """Money as an exact decimal; NULL and NaN are both missing.

    An amount is taken as it prints and kept to nine decimals. Decimals add up to the
    same total in any order, so totals do not change with the number of partitions or
    after a task is rerun, and comparing a row with a median of the same rows is safe.
    """
    dollars = amount.cast("double")
    return F.when(~F.isnan(dollars), dollars).cast(MONEY)


def usd(total: Column) -> Column:
    """Dollars from a sum of money: the double nearest to it, 0 for the sum of nothing."""
    return F.coalesce(total.cast("double"), F.lit(0.0))


def utc_day(df: DataFrame, name: str) -> Column:
    """Calendar day in UTC of a date, date-like string or timestamp column."""
    value = F.col(name)
    if isinstance(df.schema[name].dataType, T.TimestampType):
        value = F.to_utc_timestamp(value, F.current_timezone())
    return F.to_date(value)


def day_offset(day: Column, start: Column) -> Column:
    """Whole days from ``start`` to ``day``; NULL if either is missing."""
    return F.datediff(day, start)


def lifecycle_week(days: Column) -> Column:
    """Week number since the start, rounded down: days -7..-1 are week -1."""
    return F.floor(days / 7).cast("int")


def cohort_week(day: Column) -> Column:
    """Monday of the calendar week."""
    return F.trunc(day, "week")


def joined_label(*parts: Column) -> Column:
    """``a | b``; a missing part prints as ``NA``."""
    return F.concat_ws(" | ", *[F.coalesce(part, F.lit("NA")) for part in parts])


def month_start(year: int | str, month: int | str) -> Column:
    """First day of a month given its parts, e.g. ``("2024", "01")``."""
    return F.make_date(F.lit(int(year)), F.lit(int(month)), F.lit(1))


def thousands(number: Column) -> Column:
    """Whole number with thousands separators, as text."""
    return F.format_number(number, 0)
