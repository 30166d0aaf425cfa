"""Key figures and trends of a monthly (date, subscription_type, active_subscriptions) fact.

As in pandas, rows without a type belong to no group, and missing counts are skipped.
"""

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from growthgrain.functions.aggregates import sum_or_zero
from growthgrain.functions.columns import month_start, thousands
from growthgrain.operators.ordered import largest_first, top_rows

ALL_TYPES = "All"
TYPE, COUNT = "subscription_type", "active_subscriptions"


def current_subscriptions(subscriptions: DataFrame) -> DataFrame:
    """Total at the latest date, as a number and as text."""
    latest = subscriptions.agg(F.max("date")).scalar()
    return (
        subscriptions.where(F.col("date") == latest)
        .agg(
            F.max("date").alias("date"), sum_or_zero(F.col(COUNT)).alias("total_subscriptions")
        )
        .withColumn("total_text", thousands(F.col("total_subscriptions")))
    )


def most_popular_type(subscriptions: DataFrame) -> DataFrame:
    """The type with the largest total; of equals, the alphabetically first."""
    totals = (
        subscriptions.where(F.col(TYPE).isNotNull())
        .groupBy(TYPE)
        .agg(sum_or_zero(F.col(COUNT)).alias("total"))
    )
    return top_rows(totals, largest_first("total", TYPE), 1)


def months_tracked(subscriptions: DataFrame) -> DataFrame:
    """Number of distinct dates."""
    return subscriptions.agg(F.count_distinct("date").alias("months_tracked"))


def subscription_trend(
    subscriptions: DataFrame,
    subscription_type: str = ALL_TYPES,
    start: tuple[int | str, int | str] | None = None,
    end: tuple[int | str, int | str] | None = None,
) -> DataFrame:
    """One ordered series per type, from one (year, month) to another if given, both included."""
    wanted = (
        F.col(TYPE).isNotNull()
        if subscription_type == ALL_TYPES
        else F.col(TYPE) == subscription_type
    )
    return (
        subscriptions.where(wanted & F.col("date").isNotNull())
        .where(F.lit(True) if start is None else F.col("date") >= month_start(*start))
        .where(F.lit(True) if end is None else F.col("date") <= month_start(*end))
        .select("date", TYPE, COUNT)
        .orderBy(TYPE, "date")
    )


def net_change_by_year(subscriptions: DataFrame) -> DataFrame:
    """Last minus first count of each year and type.

    Rows are taken in date order. Should a type have several rows on one date, the
    smallest is its first and the largest its last.
    """
    per_date = (
        subscriptions.where(F.col(TYPE).isNotNull() & F.col("date").isNotNull())
        .groupBy("date", TYPE)
        .agg(F.min(COUNT).alias("first_value"), F.max(COUNT).alias("last_value"))
    )
    counted = F.when(F.col("first_value").isNotNull(), F.col("date"))
    return (
        per_date.groupBy(F.year("date").alias("year"), TYPE)
        .agg(
            F.min_by("first_value", counted).alias("start_of_year"),
            F.max_by("last_value", counted).alias("end_of_year"),
        )
        .withColumn("net_change", F.col("end_of_year") - F.col("start_of_year"))
        .orderBy("year", TYPE)
    )


def net_change_pivot(subscriptions: DataFrame, types: Sequence[str] | None = None) -> DataFrame:
    """Net change with one row per year and one column per type.

    Naming the types saves the job in which Spark would otherwise look them up; a type
    that is not named is then an error, as its column would be missing.
    """
    changes = net_change_by_year(subscriptions)
    if types:
        message = F.concat(F.lit("type without a column: "), F.col(TYPE))
        known = F.when(F.col(TYPE).isin(*types), F.col(TYPE)).otherwise(F.raise_error(message))
        changes = changes.withColumn(TYPE, known)
    return (
        changes.groupBy("year")
        .pivot(TYPE, list(types) if types else None)
        .agg(F.first("net_change"))
        .orderBy("year")
    )


def selector_types(subscriptions: DataFrame) -> DataFrame:
    """Types on offer: ``All``, then each type in order of first appearance."""
    seen = subscriptions.groupBy(TYPE).agg(F.min("date").alias("first_seen"))
    every = subscriptions.sparkSession.range(1).select(
        F.lit(ALL_TYPES).alias(TYPE), F.lit(None).cast("date").alias("first_seen")
    )
    return every.unionByName(seen).orderBy(F.asc_nulls_first("first_seen"), TYPE)


def selector_years(subscriptions: DataFrame) -> DataFrame:
    """Years on offer, in order."""
    return (
        subscriptions.where(F.col("date").isNotNull())
        .select(F.year("date").alias("year"))
        .distinct()
        .orderBy("year")
    )


def selector_months(subscriptions: DataFrame) -> DataFrame:
    """Months on offer, ``01`` to ``12``, whatever the data holds."""
    return (
        subscriptions.sparkSession.range(1, 13)
        .select(F.format_string("%02d", F.col("id")).alias("month"))
        .orderBy("month")
    )
