"""Profile dimension, its data-quality report, and row-level facts joined to it.

The row-level joins keep every fact row; those of a profile id that holds a large part of
the facts meet its profile in pieces.
"""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from growthgrain.functions.columns import (
    LAST_LIFECYCLE_DAY,
    cohort_week,
    day_offset,
    lifecycle_week,
    utc_day,
)
from growthgrain.operators.hot import SPREAD, join_spread
from growthgrain.operators.keys import KEY, profile_id_of, with_key
from growthgrain.plans.frames import PROFILE_COLUMNS, canonical_profiles

DIMENSION_COLUMNS = [
    "profile_id",
    *PROFILE_COLUMNS,
    "first_activity_date",
    "n_profile_rows",
    "n_acquisition_source",
    "n_country",
]


def _with_profile_id(dim: DataFrame) -> DataFrame:
    return dim.withColumn("profile_id", profile_id_of(F.col(KEY)))


def profile_dim(dim: DataFrame) -> DataFrame:
    """One row per profile.

    As written in the original analysis, ``n_acquisition_source`` and ``n_country``
    count the values of the one chosen row and so are always 1. The counts over the
    raw rows are in ``profile_conflicts_detected``.
    """
    one = F.lit(1).cast("bigint")
    return (
        _with_profile_id(dim)
        .withColumns({"n_acquisition_source": one, "n_country": one})
        .select(*DIMENSION_COLUMNS)
    )


def _in_conflict(dim: DataFrame) -> DataFrame:
    return dim.where((F.col("n_acquisition_source") > 1) | (F.col("n_country") > 1))


def profile_conflicts(dim: DataFrame) -> DataFrame:
    """Conflict report as written: empty, because both counts are always 1."""
    return _in_conflict(profile_dim(dim))


def profile_conflicts_detected(profiles: DataFrame) -> DataFrame:
    """Profiles whose raw rows disagree on source or country; NULL counts as a value."""
    counted = canonical_profiles(profiles, values=True)
    return _with_profile_id(_in_conflict(counted)).select(*DIMENSION_COLUMNS)


def _with_age(facts: DataFrame, date: str, dim: DataFrame) -> DataFrame:
    """Every fact with the source, start and age in days of its profile."""
    dated = with_key(facts.withColumn(date, utc_day(facts, date)))
    joined = join_spread(dated, dim, ["acquisition_source", "first_activity_date"])
    age = day_offset(F.col(date), F.col("first_activity_date"))
    return joined.withColumn("days_since_first_activity", age).drop(KEY, SPREAD)


def payments_enriched(payments: DataFrame, dim: DataFrame) -> DataFrame:
    """Every payment with the source, start and age in days of its profile."""
    return _with_age(payments, "reported_date", dim)


def payments_90(payments: DataFrame, dim: DataFrame) -> DataFrame:
    """Payments on day 0..90, both ends included."""
    return payments_enriched(payments, dim).where(
        F.col("days_since_first_activity").between(0, LAST_LIFECYCLE_DAY)
    )


def activity_enriched(activity: DataFrame, dim: DataFrame) -> DataFrame:
    """Every activity row with the source, start and age in days of its profile."""
    return _with_age(activity, "activity_date", dim)


def cohort_base(dim: DataFrame) -> DataFrame:
    """Profiles with install date and Monday-based install week."""
    return (
        profile_dim(dim)
        .withColumn("install_date", F.col("first_activity_date"))
        .withColumn("cohort_week", cohort_week(F.col("install_date")))
    )


def activity_lifecycle(activity: DataFrame, dim: DataFrame) -> DataFrame:
    """Activity rows in lifecycle weeks 0..12 with the cohort of their profile."""
    started = F.col("first_activity_date")
    profile = dim.withColumns({"cohort_week": cohort_week(started), "install_date": started})
    dated = with_key(activity.withColumn("activity_date", utc_day(activity, "activity_date")))
    days = day_offset(F.col("activity_date"), F.col("install_date"))
    columns = ["cohort_week", "acquisition_source", "signup_platform", "install_date"]
    return (
        join_spread(dated, profile, columns)
        .withColumn("days_since_install", days)
        .where(F.col("days_since_install").between(0, LAST_LIFECYCLE_DAY))
        .withColumn("week_since_install", lifecycle_week(F.col("days_since_install")))
        .drop(KEY, SPREAD)
    )
