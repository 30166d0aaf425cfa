"""Weekly cohort retention and revenue per user.

Denominators are kept as the original analysis has them: a cohort without an active
user in a week has no row for that week, so totals over cohorts count survivors only.
"""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from growthgrain.functions.columns import (
    LAST_LIFECYCLE_WEEK,
    cohort_week,
    lifecycle_week,
    safe_ratio,
    usd,
)
from growthgrain.functions.daybits import STRETCH, days_between
from growthgrain.operators.keys import KEY, null_safe_left
from growthgrain.operators.ordered import largest_first

SOURCE, PLATFORM, WEEK = "acquisition_source", "signup_platform", "week_since_install"
COHORT = ["cohort_week", SOURCE, PLATFORM]


def cohort_sizes(dim: DataFrame) -> DataFrame:
    """Profiles per install week, source and platform."""
    return (
        dim.withColumn("cohort_week", cohort_week(F.col("first_activity_date")))
        .groupBy(*COHORT)
        .agg(F.count("*").alias("cohort_users"))
    )


def _active_weeks(activity_life: DataFrame) -> DataFrame:
    """One row per profile and active lifecycle week.

    A set of days spans at most 11 weeks, and a week at most two sets.
    """
    first, week = F.col("first_day"), F.col(WEEK)
    earliest = F.greatest(lifecycle_week(first), F.lit(0))
    latest = F.least(lifecycle_week(first + STRETCH - 1), F.lit(LAST_LIFECYCLE_WEEK))
    return (
        activity_life.withColumn(WEEK, F.explode(F.sequence(earliest, latest)))
        .where(days_between(F.col("days"), first, week * 7, week * 7 + 6) != 0)
        .select(KEY, *COHORT, WEEK)
        .distinct()
    )


def retention_weekly(dim: DataFrame, activity_life: DataFrame) -> DataFrame:
    """Distinct active users of each cohort in each lifecycle week, and their share.

    A profile has one cohort, so counting its distinct (profile, week) rows gives
    the distinct users; the join has already put the rows of a profile together.
    """
    retained = (
        _active_weeks(activity_life)
        .groupBy(*COHORT, WEEK)
        .agg(F.count("*").alias("retained_users"))
    )
    return null_safe_left(retained, cohort_sizes(dim), COHORT).withColumn(
        "retention_rate", safe_ratio(F.col("retained_users"), F.col("cohort_users"))
    )


def payments_weekly(booking_life: DataFrame) -> DataFrame:
    """Revenue of each cohort in each lifecycle week."""
    return booking_life.groupBy(*COHORT, WEEK).agg(
        usd(F.sum("bookings")).alias("weekly_revenue_usd")
    )


def cohort_retention_revenue(retention: DataFrame, weekly: DataFrame) -> DataFrame:
    """Retention with revenue per retained user; revenue of weeks without users drops out."""
    return (
        null_safe_left(retention, weekly, [*COHORT, WEEK])
        .withColumn("weekly_revenue_usd", F.coalesce(F.col("weekly_revenue_usd"), F.lit(0.0)))
        .withColumn(
            "avg_revenue_per_retained_user",
            safe_ratio(F.col("weekly_revenue_usd"), F.col("retained_users")),
        )
    )


def retention_channel_summary(retention_revenue: DataFrame) -> DataFrame:
    """Unweighted means over cohorts per source, platform and week."""
    return retention_revenue.groupBy(SOURCE, PLATFORM, WEEK).agg(
        F.avg("retention_rate").alias("mean_retention_rate"),
        F.avg("avg_revenue_per_retained_user").alias("mean_arpru_weekly"),
    )


def retention_ios_android(summary: DataFrame) -> DataFrame:
    """The two mobile platforms of the channel summary."""
    return summary.where(F.col(PLATFORM).isin("iOS", "Android"))


def retention_platform_weighted(retention: DataFrame) -> DataFrame:
    """Retained over cohort users per platform and week."""
    return (
        retention.groupBy(PLATFORM, WEEK)
        .agg(
            F.sum("retained_users").alias("retained_users_total"),
            F.sum("cohort_users").alias("cohort_users_total"),
        )
        .withColumn(
            "weighted_retention_rate",
            safe_ratio(F.col("retained_users_total"), F.col("cohort_users_total")),
        )
    )


def retention_platform_week1plus(weighted: DataFrame) -> DataFrame:
    """Weighted retention from week 1 on."""
    return weighted.where(F.col(WEEK) >= 1)


def weekly_rpu(dim: DataFrame, booking_life: DataFrame) -> DataFrame:
    """Weekly revenue over all installs of a source and platform."""
    installs = dim.groupBy(SOURCE, PLATFORM).agg(F.count("*").alias("installs"))
    weekly = booking_life.groupBy(SOURCE, PLATFORM, WEEK).agg(
        usd(F.sum("bookings")).alias("weekly_revenue_usd")
    )
    return null_safe_left(weekly, installs, [SOURCE, PLATFORM]).withColumn(
        "revenue_per_installed_user", safe_ratio(F.col("weekly_revenue_usd"), F.col("installs"))
    )


def weekly_rpu_platform(rpu: DataFrame) -> DataFrame:
    """Unweighted mean over sources of weekly revenue per installed user."""
    return rpu.groupBy(PLATFORM, WEEK).agg(F.avg("revenue_per_installed_user").alias("mean_rpu"))


def week1_channel_platform(summary: DataFrame) -> DataFrame:
    """Week-1 rows of the channel summary."""
    return summary.where(F.col(WEEK) == 1)


def week1_scorecard(summary: DataFrame) -> DataFrame:
    """Week-1 rows of the channel summary, best retention first."""
    return week1_channel_platform(summary).orderBy(
        *largest_first("mean_retention_rate", SOURCE, PLATFORM)
    )


def retention_curve_platform(retention: DataFrame) -> DataFrame:
    """Unweighted mean retention over cohorts per platform and week."""
    mean = F.avg("retention_rate").alias("mean_retention_rate")
    return retention.groupBy(PLATFORM, WEEK).agg(mean)


def arpru_platform(retention_revenue: DataFrame) -> DataFrame:
    """Unweighted mean revenue per retained user per platform and week."""
    return retention_revenue.groupBy(PLATFORM, WEEK).agg(
        F.avg("avg_revenue_per_retained_user").alias("mean_arpru")
    )


def retention_heatmap(retention: DataFrame) -> DataFrame:
    """Mean over platforms of the mean retention over cohorts, per source and week."""
    by_platform = retention.groupBy(SOURCE, PLATFORM, WEEK).agg(F.avg("retention_rate").alias("mean"))
    return by_platform.groupBy(SOURCE, WEEK).agg(F.avg("mean").alias("mean_retention_rate"))


def summary_q3(scorecard: DataFrame) -> DataFrame:
    return scorecard.select(SOURCE, PLATFORM, "mean_retention_rate", "mean_arpru_weekly")
