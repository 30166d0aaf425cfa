"""Explicit schemas of every input table and of the two empty result contracts.

Schemas are never inferred: inference would turn the profile id ``0012`` into
the integer ``12``.
"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

PROFILES = T.StructType(
    [
        T.StructField("profile_id", T.StringType()),
        T.StructField("acquisition_source", T.StringType()),
        T.StructField("signup_country_code", T.StringType()),
        T.StructField("signup_platform", T.StringType()),
        T.StructField("first_activity_time", T.TimestampType()),
    ]
)

PAYMENTS = T.StructType(
    [
        T.StructField("profile_id", T.StringType()),
        T.StructField("reported_date", T.DateType()),
        T.StructField("gross_bookings_usd", T.DoubleType()),
    ]
)

ACTIVITY = T.StructType(
    [
        T.StructField("profile_id", T.StringType()),
        T.StructField("activity_date", T.DateType()),
    ]
)

SUBSCRIPTIONS = T.StructType(
    [
        T.StructField("date", T.DateType()),
        T.StructField("subscription_type", T.StringType()),
        T.StructField("active_subscriptions", T.LongType()),
    ]
)

EXPERIMENT_RESULTS = T.StructType(
    [
        T.StructField("geo_cell", T.StringType()),
        T.StructField("group", T.StringType()),
        T.StructField("week", T.IntegerType()),
        T.StructField("spend_meta", T.DoubleType()),
        T.StructField("installs", T.DoubleType()),
        T.StructField("revenue_90_proxy", T.DoubleType()),
        T.StructField("payer_rate", T.DoubleType()),
        T.StructField("retention_w1", T.DoubleType()),
    ]
)

WEEKLY_SCORECARD = T.StructType(
    [
        T.StructField("week_start", T.DateType()),
        T.StructField("acquisition_source", T.StringType()),
        T.StructField("signup_platform", T.StringType()),
        T.StructField("installs", T.DoubleType()),
        T.StructField("ltv90_proxy", T.DoubleType()),
        T.StructField("payer_rate", T.DoubleType()),
        T.StructField("arppu", T.DoubleType()),
        T.StructField("week1_retention", T.DoubleType()),
        T.StructField("week4_retention", T.DoubleType()),
        T.StructField("rpi", T.DoubleType()),
        T.StructField("note", T.StringType()),
    ]
)


def experiment_results_template(spark: SparkSession) -> DataFrame:
    """Empty table that says how experiment results must be supplied."""
    return spark.createDataFrame([], EXPERIMENT_RESULTS)


def weekly_scorecard_template(spark: SparkSession) -> DataFrame:
    """Empty table that says what the weekly scorecard holds."""
    return spark.createDataFrame([], WEEKLY_SCORECARD)
