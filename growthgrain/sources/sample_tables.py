"""The input tables, derived from the sample order tables.

Customers play the profiles, their orders the payments and the shipments of their order
lines the activity. Orders by month and priority play the
subscription fact.
"""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


class SampleTables:
    """The order tables of a folder; each is opened once, on first use."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.folder = folder

    def __getattr__(self, table: str) -> DataFrame:
        if table.startswith("_"):
            raise AttributeError(table)
        opened = self.spark.read.parquet(f"{self.folder}/{table}.parquet")
        setattr(self, table, opened)
        return opened


def _text(key: str) -> Column:
    return F.col(key).cast("string")


def _country(customers: DataFrame, nations: DataFrame) -> DataFrame:
    return customers.join(nations, F.col("c_nationkey") == F.col("n_nationkey"), "left")


def profiles(tables: SampleTables) -> DataFrame:
    """One row per customer, starting with the first order."""
    starts = tables.orders.groupBy("o_custkey").agg(
        F.min("o_orderdate").alias("first_activity_time")
    )
    customers = _country(tables.customer, tables.nation)
    platform = F.element_at(
        F.array(F.lit("iOS"), F.lit("Android"), F.lit("Web")),
        (F.pmod("c_custkey", F.lit(3)) + 1).cast("int"),
    )
    return customers.join(starts, F.col("c_custkey") == F.col("o_custkey"), "left").select(
        _text("c_custkey").alias("profile_id"),
        F.col("c_mktsegment").alias("acquisition_source"),
        F.col("n_name").alias("signup_country_code"),
        platform.alias("signup_platform"),
        "first_activity_time",
    )


def payments(tables: SampleTables) -> DataFrame:
    """Orders, each paid by the customer with the even number of two neighbours."""
    payer = F.col("o_custkey") - F.pmod("o_custkey", F.lit(2))
    return tables.orders.select(
        payer.cast("string").alias("profile_id"),
        F.to_date("o_orderdate").alias("reported_date"),
        F.col("o_totalprice").alias("gross_bookings_usd"),
    )


def activity(tables: SampleTables) -> DataFrame:
    """Shipments of order lines."""
    return tables.lineitem.join(tables.orders, F.col("l_orderkey") == F.col("o_orderkey")).select(
        _text("o_custkey").alias("profile_id"), F.to_date("l_shipdate").alias("activity_date")
    )


def subscriptions(tables: SampleTables) -> DataFrame:
    """Customers with an order, by month and order priority."""
    return tables.orders.groupBy(
        F.trunc("o_orderdate", "month").alias("date"),
        F.col("o_orderpriority").alias("subscription_type"),
    ).agg(F.count_distinct("o_custkey").alias("active_subscriptions"))


# A second set of tables in which one profile id is missing for a whole customer
# segment, profiles have several and contradicting rows, sources are missing and
# some payments belong to no known profile.


def _anonymous_id() -> Column:
    return F.when(F.col("c_mktsegment") != "HOUSEHOLD", _text("o_custkey")).alias("profile_id")


def _payer_id() -> Column:
    """The same, but for facts of every seventh customer: under an id no profile has."""
    unknown = F.pmod("o_custkey", F.lit(7)) == 0
    known_id = _anonymous_id()
    return F.when(unknown, F.concat(F.lit("x"), known_id)).otherwise(known_id).alias("profile_id")


def _orders_with_customer(tables: SampleTables) -> DataFrame:
    customers = _country(tables.customer, tables.nation)
    return tables.orders.join(customers, F.col("o_custkey") == F.col("c_custkey"))


def touch_profiles(tables: SampleTables) -> DataFrame:
    """One row per order, so a customer has as many rows as orders."""
    source = F.nullif(F.col("o_orderpriority"), F.lit("4-NOT SPECIFIED"))
    platform = F.when(F.year("o_orderdate") < 1998, "iOS").otherwise("Android")
    return _orders_with_customer(tables).select(
        _anonymous_id(),
        source.alias("acquisition_source"),
        F.nullif(F.col("n_name"), F.lit("NATION_7")).alias("signup_country_code"),
        platform.alias("signup_platform"),
        F.col("o_orderdate").alias("first_activity_time"),
    )


def touch_payments(tables: SampleTables) -> DataFrame:
    """Every order; prices rise with the number of the country, so that some large
    segments earn little."""
    price = F.nullif(F.col("o_totalprice"), F.round("o_totalprice", 0)) * F.col("c_nationkey")
    price = F.round(price, 2)
    return _orders_with_customer(tables).select(
        _payer_id(),
        F.to_date("o_orderdate").alias("reported_date"),
        price.alias("gross_bookings_usd"),
    )


def touch_activity(tables: SampleTables) -> DataFrame:
    """Shipments of order lines."""
    orders = _orders_with_customer(tables)
    return tables.lineitem.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select(
        _payer_id(), F.to_date("l_shipdate").alias("activity_date")
    )


def experiment_results(tables: SampleTables) -> DataFrame:
    """Installs per country and install week; countries of two regions are treated."""
    in_region = F.col("n_regionkey") == F.col("r_regionkey")
    treated = tables.nation.join(tables.region, in_region).select(
        F.col("n_name").alias("geo_cell"),
        F.when(F.col("r_name").isin("AMERICA", "EUROPE"), "treatment")
        .otherwise("control")
        .alias("group"),
    )
    first_week = F.to_date(F.lit("1995-01-01"))
    installs = (
        profiles(tables)
        .where(F.col("first_activity_time").isNotNull())
        .groupBy(
            F.col("signup_country_code").alias("geo_cell"),
            F.floor(F.datediff(F.to_date("first_activity_time"), first_week) / 7)
            .cast("int")
            .alias("week"),
        )
        .agg(F.count("*").cast("double").alias("installs"))
    )
    missing = F.lit(None).cast("double")
    return installs.join(treated, "geo_cell").select(
        "geo_cell",
        "group",
        "week",
        missing.alias("spend_meta"),
        "installs",
        missing.alias("revenue_90_proxy"),
        missing.alias("payer_rate"),
        missing.alias("retention_w1"),
    )
