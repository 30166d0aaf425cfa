"""Installs, revenue per install (RPI), payer rates and anomalies by channel and country."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from growthgrain.functions.aggregates import pearson
from growthgrain.functions.columns import joined_label, safe_ratio, usd
from growthgrain.operators.ordered import largest_first, quantiles, top_rows
from growthgrain.operators.stats import scalars, weighted_sd

SEGMENT = ["acquisition_source", "signup_country_code"]
RPI = "revenue_per_install_usd"


def _installed(segments: DataFrame) -> DataFrame:
    """Segments with an install; revenue of any other group is not part of the tables."""
    return segments.where(F.col("installs") > 0)


def installs_by_segment(dim: DataFrame) -> DataFrame:
    """Profiles per source and country."""
    return dim.groupBy(*SEGMENT).agg(F.count("*").alias("installs"))


def revenue_by_segment(segments: DataFrame) -> DataFrame:
    """Revenue per source and country; payments of unknown profiles are under NULL, NULL."""
    return segments.where(F.col("paying_ids") > 0).select(
        *SEGMENT, usd(F.col("revenue")).alias("total_revenue_usd")
    )


def _with_rpi(segments: DataFrame) -> DataFrame:
    return (
        _installed(segments)
        .withColumn("total_revenue_usd", usd(F.col("revenue")))
        .withColumn(RPI, safe_ratio(F.col("total_revenue_usd"), F.col("installs")))
    )


def segment_rpi(segments: DataFrame) -> DataFrame:
    """Installs, revenue and revenue per install of each segment."""
    return _with_rpi(segments).select(*SEGMENT, "installs", "total_revenue_usd", RPI)


def install_correlations(segments: DataFrame) -> DataFrame:
    """Correlation of installs with revenue and with RPI, one row each."""
    return (
        segment_rpi(segments)
        .agg(
            pearson(F.col("installs"), F.col("total_revenue_usd")).alias("with_revenue"),
            pearson(F.col("installs"), F.col(RPI)).alias("with_rpi"),
        )
        .select(
            F.stack(
                F.lit(2),
                F.lit("corr_installs_revenue"),
                F.col("with_revenue"),
                F.lit("corr_installs_rpi"),
                F.col("with_rpi"),
            ).alias("metric", "value")
        )
    )


def _totals() -> dict[str, Column]:
    return {"installs": F.sum("installs"), "total_revenue_usd": usd(F.sum("revenue"))}


def _channel_rpi() -> Column:
    return safe_ratio(F.col("total_revenue_usd"), F.col("installs"))


def channel_efficiency(segments: DataFrame) -> DataFrame:
    """Totals per channel, as written in the original analysis.

    There the channel figures hide the country figures of the same name before the
    spread is taken, so ``rpi_std`` is 0 and ``rpi_min`` and ``rpi_max`` equal the
    channel's RPI. The spread over countries is in ``channel_efficiency_per_country``.
    """
    totals = _installed(segments).groupBy("acquisition_source")
    return (
        totals.agg(*[total.alias(name) for name, total in _totals().items()])
        .withColumn(RPI, _channel_rpi())
        .withColumns({"rpi_std": F.lit(0.0), "rpi_min": F.col(RPI), "rpi_max": F.col(RPI)})
    )


def channel_efficiency_per_country(segments: DataFrame) -> DataFrame:
    """Totals per channel with the install-weighted spread of its countries' RPI.

    ``rpi_std`` comes from exact sums, so that comparing it with a median of the same
    column does not hinge on the order of a sum.
    """
    key = ["acquisition_source"]
    more = _totals() | {"rpi_min": F.min(RPI), "rpi_max": F.max(RPI)}
    return weighted_sd(_with_rpi(segments), key, RPI, "installs", "rpi_std", **more).select(
        *key,
        "installs",
        "total_revenue_usd",
        _channel_rpi().alias(RPI),
        "rpi_std",
        "rpi_min",
        "rpi_max",
    )


def segment_thresholds(segments: DataFrame) -> DataFrame:
    """Median and 90th percentile of RPI, quartiles of installs: exact, interpolated."""
    wanted = {
        "rpi_median": (RPI, 0.5),
        "install_q75": ("installs", 0.75),
        "install_q25": ("installs", 0.25),
        "rpi_q90": (RPI, 0.9),
    }
    return quantiles(segment_rpi(segments), wanted)


def segment_anomalies(segments: DataFrame) -> DataFrame:
    """Large segments that earn little per install, and small ones that earn a lot."""
    limit = scalars(segment_thresholds(segments))
    installs, rpi = F.col("installs"), F.col(RPI)
    large_and_poor = (installs >= limit["install_q75"]) & (rpi <= limit["rpi_median"])
    small_and_rich = (installs <= limit["install_q25"]) & (rpi >= limit["rpi_q90"])
    return (
        segment_rpi(segments)
        .where(large_and_poor | small_and_rich)
        .orderBy(*largest_first(RPI, *SEGMENT))
    )


def payer_rate_by_segment(segments: DataFrame) -> DataFrame:
    """Payers, i.e. profiles with any payment row, and their share of installs."""
    return _installed(segments).select(
        *SEGMENT,
        "payers",
        safe_ratio(F.col("payers"), F.col("installs")).alias("payer_rate"),
    )


def segment_enhanced(segments: DataFrame, dim: DataFrame) -> DataFrame:
    """Segment RPI with payers, payer rate and share of all installs.

    All installs are counted on the profiles, which spares reading payments again.
    """
    total = dim.agg(F.count("*")).scalar()
    return _with_rpi(segments).select(
        *SEGMENT,
        "installs",
        "total_revenue_usd",
        RPI,
        "payers",
        safe_ratio(F.col("payers"), F.col("installs")).alias("payer_rate"),
        (F.col("installs") / total).alias("install_share"),
    )


def with_rpi_cv(efficiency: DataFrame) -> DataFrame:
    """Channels by RPI, with the coefficient of variation; NULL where RPI is 0."""
    return efficiency.withColumn(
        "rpi_cv", safe_ratio(F.col("rpi_std"), F.col(RPI), default=None)
    ).orderBy(*largest_first(RPI, "acquisition_source"))


def channel_rank(efficiency: DataFrame) -> DataFrame:
    """Channels by RPI with spread and coefficient of variation."""
    return with_rpi_cv(efficiency).select(
        "acquisition_source", "installs", "total_revenue_usd", RPI, "rpi_std", "rpi_cv"
    )


def payer_rate_by_channel(segments: DataFrame) -> DataFrame:
    """Payers over installs per channel, best first."""
    return (
        _installed(segments)
        .groupBy("acquisition_source")
        .agg(F.sum("installs").alias("installs"), F.sum("payers").alias("payers"))
        .withColumn("payer_rate", safe_ratio(F.col("payers"), F.col("installs")))
        .orderBy(*largest_first("payer_rate", "acquisition_source"))
    )


def top_segments(counted: DataFrame, n: int = 15) -> DataFrame:
    """The ``n`` segments with most installs, labelled; ``counted`` has a row per segment."""
    biggest = top_rows(counted, largest_first("installs", *SEGMENT), n)
    return biggest.withColumn("segment", joined_label(*[F.col(c) for c in SEGMENT]))


def summary_q1(efficiency: DataFrame) -> DataFrame:
    return channel_rank(efficiency).select(
        "acquisition_source", "installs", RPI, "rpi_std", "rpi_cv"
    )
