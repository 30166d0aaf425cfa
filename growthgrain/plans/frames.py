"""The conformed frames all marketing queries start from.

Any one profile id may hold a large part of the payments or of the activity. Activity is
reduced before it is joined, and the reduction combines on the map side: what reaches the
join is at most one row per profile and 64 calendar days. Payments meet the profiles in one
exchange, those of frequent ids in pieces (``join_spread``); stored ones are added up per
profile and day and do not move.
"""

from functools import cached_property

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from growthgrain.functions.columns import (
    LAST_LIFECYCLE_DAY,
    cohort_week,
    day_offset,
    lifecycle_week,
    money,
    utc_day,
)
from growthgrain.functions.daybits import STRETCH, bit_of, days_between, first_day, stretch_of
from growthgrain.operators.dedup import first_row_by
from growthgrain.operators.hot import LEAST, SPREAD, join_spread
from growthgrain.operators.keys import KEY, one_row_per, with_key
from growthgrain.plans import ltv, retention

PROFILE_COLUMNS = [
    "acquisition_source",
    "signup_country_code",
    "signup_platform",
    "first_activity_time",
]

# Derived frames with one row per key.
UNIQUE = {
    "dim": [KEY],
    "booking_days": [KEY, "reported_date"],
    "activity_stretches": [KEY, "stretch"],
}


def canonical_profiles(profiles: DataFrame, values: bool = False) -> DataFrame:
    """One row per profile: its first row by source, country, platform and time.

    With ``values``, also how many different sources and countries its rows have; rows
    are then first reduced to one per profile, source and country.
    """
    keyed = with_key(profiles)
    first, rows, found = first_row_by(PROFILE_COLUMNS), F.count("*"), {}
    if values:
        counted = {"n_acquisition_source": "acquisition_source", "n_country": "signup_country_code"}
        keyed = keyed.groupBy(KEY, *counted.values()).agg(first.alias("first"), rows.alias("rows"))
        first, rows = F.min("first"), F.sum("rows")
        found = {n: F.size(F.collect_set(F.struct(c))).cast("bigint") for n, c in counted.items()}
    return (
        keyed.groupBy(KEY)
        .agg(
            first.alias("first"),
            rows.alias("n_profile_rows"),
            *[value.alias(name) for name, value in found.items()],
        )
        .select(KEY, *[f"first.{c}" for c in PROFILE_COLUMNS], "n_profile_rows", *found)
        .transform(
            lambda d: d.withColumn("first_activity_date", utc_day(d, "first_activity_time"))
        )
    )


def keyed_bookings(payments: DataFrame) -> DataFrame:
    """Payments as (pk, day, exact money), still one row per payment."""
    return with_key(payments).select(
        KEY,
        utc_day(payments, "reported_date").alias("reported_date"),
        money(F.col("gross_bookings_usd")).alias("bookings"),
    )


def bookings_per_day(bookings: DataFrame) -> DataFrame:
    """One row per profile and payment day; undated payments are kept as one more day."""
    return bookings.groupBy(KEY, "reported_date").agg(
        F.sum("bookings").alias("bookings")
    )


def activity_stretches(activity: DataFrame) -> DataFrame:
    """Active days of each profile, as one set of days per 64-day stretch."""
    day = F.col("activity_date")
    return (
        with_key(activity)
        .select(KEY, utc_day(activity, "activity_date").alias("activity_date"))
        .where(day.isNotNull())
        .groupBy(KEY, stretch_of(day).alias("stretch"))
        .agg(F.bit_or(bit_of(day)).alias("days"))
    )


def _life_of(dim: DataFrame) -> DataFrame:
    return dim.select(KEY, "acquisition_source", "signup_platform", "first_activity_date")


def _cohort() -> Column:
    return cohort_week(F.col("first_activity_date")).alias("cohort_week")


def bookings_in_life(joined: DataFrame) -> DataFrame:
    """Payments of known profiles on day 0..90 (week 0..12) of their life.

    Payments outside that span, of unknown profiles, or of profiles without a start
    have no place in it.
    """
    age = day_offset(F.col("reported_date"), F.col("first_activity_date"))
    return (
        joined.withColumn("day", age)
        .where(F.col("day").between(0, LAST_LIFECYCLE_DAY))
        .select(
            KEY,
            SPREAD,
            _cohort(),
            "acquisition_source",
            "signup_platform",
            "day",
            lifecycle_week(F.col("day")).alias("week_since_install"),
            "bookings",
        )
    )


def activity_in_life(stretches: DataFrame, dim: DataFrame) -> DataFrame:
    """Active days 0..90 of known profiles: sets of days and the day their first bit is."""
    first, last = F.col("first_day"), F.lit(LAST_LIFECYCLE_DAY)
    return (
        stretches.join(_life_of(dim), KEY)
        .withColumn("first_day", first_day(F.col("stretch"), F.col("first_activity_date")))
        .where(first.between(1 - STRETCH, LAST_LIFECYCLE_DAY))
        .withColumn("days", days_between(F.col("days"), first, F.lit(0), last))
        .where(F.col("days") != 0)
        .select(KEY, _cohort(), "acquisition_source", "signup_platform", "first_day", "days")
    )


def segment_facts(dim: DataFrame, bookings: DataFrame) -> DataFrame:
    """Installs, payers and revenue per (source, country), from one pass over both sides.

    Payments are first added up per profile, so both sides of the join have one row
    per profile. Payments of unknown profiles fall into the (NULL, NULL) group, as
    do profiles that have neither source nor country.
    """
    paid = bookings.groupBy(F.col(KEY).alias("paid_key")).agg(
        F.sum("bookings").alias("bookings")
    )
    profiles = dim.select(KEY, "acquisition_source", "signup_country_code")
    return segments_of(profiles.join(paid, F.col(KEY) == F.col("paid_key"), "full"))


def profile_value(dim: DataFrame, booking_days: DataFrame) -> DataFrame:
    """All revenue and that of day 0..90 side by side, one row per profile or unknown payer.

    Payments are read once for both, and meet the profiles as one row per day: where a
    query takes a median of one of them besides, both read the same shuffle.
    """
    age = day_offset(F.col("reported_date"), F.col("first_activity_date"))
    in_90 = age.between(0, LAST_LIFECYCLE_DAY)
    paid = (
        booking_days.join(dim.select(KEY, "first_activity_date"), KEY, "left")
        .groupBy(F.col(KEY).alias("paid_key"))
        .agg(
            F.sum("bookings").alias("bookings"),
            F.count_if(in_90).alias("days_90"),
            F.sum(F.when(in_90, F.col("bookings"))).alias("bookings_90"),
        )
    )
    profiles = dim.select(KEY, "acquisition_source", "signup_country_code")
    return profiles.join(paid, F.col(KEY) == F.col("paid_key"), "full")


def segments_of(value: DataFrame) -> DataFrame:
    """Installs, payers and revenue per (source, country) from one row per profile."""
    installed, has_paid = F.col(KEY).isNotNull(), F.col("paid_key").isNotNull()
    return value.groupBy("acquisition_source", "signup_country_code").agg(
        F.count(KEY).alias("installs"),
        F.count_if(installed & has_paid).alias("payers"),
        F.count("paid_key").alias("paying_ids"),
        F.sum("bookings").alias("revenue"),
    )


class GrowthFrames:
    """The three raw tables and, built on first use, the frames derived from them.

    Nothing here runs a job; a frame that several parts of one query use is the same
    plan each time, so Spark shuffles it once. ``ready`` are derived frames, by name,
    that are to be taken from elsewhere, e.g. from a stored table.

    A profile id with more payments than ``hot_rows``, and than one in 2000, meets its
    profile in pieces.
    """

    def __init__(
        self,
        profiles: DataFrame,
        payments: DataFrame,
        activity: DataFrame,
        hot_rows: int = LEAST,
        **ready: DataFrame,
    ):
        self.profiles = profiles
        self.payments = payments
        self.activity = activity
        self.hot_rows = hot_rows
        self.ready = ready
        vars(self).update(ready)

    def with_ready(self, trusted: bool = False, **frames: DataFrame) -> "GrowthFrames":
        """The same tables with more derived frames taken from elsewhere.

        Frames that must hold one row per key are checked as part of every query over
        them: a second row for a key fails the query. Frames that were built here may be
        ``trusted``.
        """
        if not trusted:
            frames = {
                name: one_row_per(frame, UNIQUE[name]) if name in UNIQUE else frame
                for name, frame in frames.items()
            }
        return GrowthFrames(
            self.profiles,
            self.payments,
            self.activity,
            self.hot_rows,
            **(self.ready | frames),
        )

    @cached_property
    def dim(self) -> DataFrame:
        return canonical_profiles(self.profiles)

    @cached_property
    def bookings(self) -> DataFrame:
        return keyed_bookings(self.payments)

    @cached_property
    def booking_days(self) -> DataFrame:
        return bookings_per_day(self.bookings)

    @cached_property
    def activity_stretches(self) -> DataFrame:
        return activity_stretches(self.activity)

    def _paid(self, *columns: str) -> DataFrame:
        """Payments with columns of their profile, those on the days of any life at least.
        Stored ones are one row per profile and day, in the partitioning of the profiles."""
        if "booking_days" in self.ready:
            days = self.ready.get("life_days", self.booking_days)
            return days.join(self.dim.select(KEY, *columns), KEY, "left").withColumn(SPREAD, F.col(KEY))
        return join_spread(self.bookings, self.dim, list(columns), least=self.hot_rows)

    @cached_property
    def profile_value(self) -> DataFrame:
        return profile_value(self.dim, self.booking_days)

    @cached_property
    def segments(self) -> DataFrame:
        return segment_facts(self.dim, self.bookings)

    @cached_property
    def booking_life(self) -> DataFrame:
        life = ["acquisition_source", "signup_platform", "first_activity_date"]
        return bookings_in_life(self._paid(*life))

    @cached_property
    def activity_life(self) -> DataFrame:
        return activity_in_life(self.activity_stretches, self.dim)

    @cached_property
    def ltv_90(self) -> DataFrame:
        return ltv.ltv_90(self.dim, self.booking_life)

    @cached_property
    def retention_weekly(self) -> DataFrame:
        return retention.retention_weekly(self.dim, self.activity_life)

    @cached_property
    def cohort_retention_revenue(self) -> DataFrame:
        weekly = retention.payments_weekly(self.booking_life)
        return retention.cohort_retention_revenue(self.retention_weekly, weekly)
