"""90-day lifetime value (LTV) per channel: value, rank, curve, drivers, model."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from growthgrain.functions.columns import safe_ratio, usd
from growthgrain.functions.daybits import days_between
from growthgrain.operators.hot import SPREAD, n_keys
from growthgrain.operators.keys import KEY, null_safe_left
from growthgrain.operators.ordered import largest_first, quantiles, ranked, running_sum
from growthgrain.operators.regression import ols_fit_predict
from growthgrain.operators.stats import scalars

SOURCE = "acquisition_source"

# Driver labels.
STRONG_ON_BOTH = "Strong payer rate and ARPPU"
DRIVEN_BY_CONVERSION = "Driven more by payer conversion"
DRIVEN_BY_ARPPU = "Driven more by ARPPU"
WEAK_ON_BOTH = "Weak on both drivers"


def installs_by_channel(dim: DataFrame) -> DataFrame:
    """Profiles per channel."""
    return dim.groupBy(SOURCE).agg(F.count("*").alias("installs"))


def payers_90(booking_life: DataFrame) -> DataFrame:
    """Distinct payers and revenue on day 0..90 per channel.

    A profile has one channel, so it is counted once by first reducing to one row
    per profile; the join has already put those rows together, those of a hot profile
    in pieces.
    """
    return (
        booking_life.groupBy(SPREAD, KEY, SOURCE)
        .agg(F.sum("bookings").alias("bookings"))
        .groupBy(SOURCE)
        .agg(
            n_keys().alias("payers_90"),
            usd(F.sum("bookings")).alias("revenue_90_usd"),
        )
    )


def ltv_90(dim: DataFrame, booking_life: DataFrame) -> DataFrame:
    """Revenue on day 0..90 per install, with payer rate and revenue per payer."""
    return _with_rates(
        null_safe_left(installs_by_channel(dim), payers_90(booking_life), [SOURCE])
    )


def ltv_of(value: DataFrame) -> DataFrame:
    """The same from one row per profile with its revenue on day 0..90.

    Unknown payers have no such day. They are dropped last, so that the plan below is
    the one the segments are counted from, and runs once.
    """
    return _with_rates(
        value.groupBy(SOURCE)
        .agg(
            F.count(KEY).alias("installs"),
            F.count_if(F.col("days_90") > 0).alias("payers_90"),
            usd(F.sum("bookings_90")).alias("revenue_90_usd"),
        )
        .where(F.col("installs") > 0)
    )


def _with_rates(counted: DataFrame) -> DataFrame:
    installs, payers, revenue = F.col("installs"), F.col("payers_90"), F.col("revenue_90_usd")
    return (
        counted.withColumns(
            {
                "payers_90": F.coalesce(payers, F.lit(0)),
                "revenue_90_usd": F.coalesce(revenue, F.lit(0.0)),
            }
        )
        .withColumns(
            {
                "ltv_90_usd": safe_ratio(revenue, installs),
                "payer_rate_90": safe_ratio(payers, installs),
                "arppu_90_usd": safe_ratio(revenue, payers),
            }
        )
    )


def retention_30_37(activity_life: DataFrame) -> DataFrame:
    """Distinct users active on day 30..37, both ends included, per channel."""
    active = days_between(F.col("days"), F.col("first_day"), F.lit(30), F.lit(37)) != 0
    return (
        activity_life.where(active)
        .select(KEY, SOURCE)
        .distinct()
        .groupBy(SOURCE)
        .agg(F.count("*").alias("retained_users_30_37"))
    )


def ltv_model(ltv: DataFrame, retention: DataFrame) -> DataFrame:
    """LTV with day 30..37 retention and the product of the three rates."""
    return (
        null_safe_left(ltv, retention, [SOURCE])
        .withColumn(
            "retained_users_30_37", F.coalesce(F.col("retained_users_30_37"), F.lit(0))
        )
        .withColumn(
            "retention_30_37", safe_ratio(F.col("retained_users_30_37"), F.col("installs"))
        )
        .withColumn(
            "predicted_ltv_retention_arppu",
            F.col("retention_30_37") * F.col("payer_rate_90") * F.col("arppu_90_usd"),
        )
    )


def ltv_regression(model_table: DataFrame) -> DataFrame:
    """Model table with the least-squares fit of LTV on its three rates."""
    return ols_fit_predict(
        model_table,
        "ltv_90_usd",
        ["retention_30_37", "payer_rate_90", "arppu_90_usd"],
        "predicted_ltv_regression",
    )


def best_first(ltv: DataFrame) -> DataFrame:
    """A channel table sorted by LTV, for writing."""
    return ltv.orderBy(*largest_first("ltv_90_usd", SOURCE))


def ltv_rank(ltv: DataFrame) -> DataFrame:
    """Channels with their position by LTV."""
    return ranked(ltv, "ltv_90_usd", [SOURCE], "ltv_rank").select(
        "ltv_rank",
        SOURCE,
        "installs",
        "payers_90",
        "payer_rate_90",
        "arppu_90_usd",
        "revenue_90_usd",
        "ltv_90_usd",
    ).orderBy("ltv_rank")


def cumulative_ltv_curve(dim: DataFrame, booking_life: DataFrame) -> DataFrame:
    """Weekly and running revenue and LTV per channel; weeks without revenue have no row."""
    weekly = booking_life.groupBy(SOURCE, "week_since_install").agg(
        F.sum("bookings").alias("booked")
    )
    cumulative = usd(running_sum(F.coalesce("booked", F.lit(0)), [SOURCE], "week_since_install"))
    return (
        null_safe_left(weekly, installs_by_channel(dim), [SOURCE])
        .select(
            SOURCE,
            "week_since_install",
            usd(F.col("booked")).alias("weekly_revenue_usd"),
            "installs",
            cumulative.alias("cumulative_revenue_usd"),
        )
        .withColumn(
            "cumulative_ltv_usd", safe_ratio(F.col("cumulative_revenue_usd"), F.col("installs"))
        )
        .orderBy(F.asc_nulls_last(SOURCE), "week_since_install")
    )


def ltv_drivers(ltv: DataFrame) -> DataFrame:
    """What drives each channel's LTV, against the medians over channels."""
    median = scalars(
        quantiles(ltv, {"payer_rate": ("payer_rate_90", 0.5), "arppu": ("arppu_90_usd", 0.5)})
    )
    converts = F.col("payer_rate_90") >= median["payer_rate"]
    spends = F.col("arppu_90_usd") >= median["arppu"]
    return best_first(
        ltv.withColumn(
            "monetization_comment",
            F.when(converts & spends, STRONG_ON_BOTH)
            .when(converts, DRIVEN_BY_CONVERSION)
            .when(spends, DRIVEN_BY_ARPPU)
            .otherwise(WEAK_ON_BOTH),
        )
    )


def summary_q2(ltv: DataFrame) -> DataFrame:
    return ltv_rank(ltv).select(SOURCE, "installs", "payer_rate_90", "arppu_90_usd", "ltv_90_usd")
