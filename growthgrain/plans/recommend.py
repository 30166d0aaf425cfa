"""Channel recommendations and the experiment trend."""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from growthgrain.operators.keys import null_safe_left
from growthgrain.operators.ordered import quantiles
from growthgrain.plans.ltv import SOURCE, best_first

# Channels singled out by default, and the texts of the table.
SCALE_SOURCES = ("acquisition_source_6", "acquisition_source_1")
TRIM_SOURCES = ("acquisition_source_5", "acquisition_source_7")
SCALE = "Scale gradually (+10% to +20%) with guardrails"
TRIM = "Hold or trim pending diagnosis"
MAINTAIN = "Maintain as stable base and test creative/offers"
VOLATILE = "High volatility; watch marginal returns"
STABLE = "More stable"


def channel_recommendation(
    ltv: DataFrame,
    efficiency: DataFrame,
    scale: Sequence[str] = SCALE_SOURCES,
    trim: Sequence[str] = TRIM_SOURCES,
    median_spread: Column | None = None,
) -> DataFrame:
    """LTV and efficiency per channel with an action and a caution.

    With the efficiency table as written every spread is 0, which is also its
    median, so every channel is called volatile; pass the per-country table to
    compare real spreads. ``median_spread`` is taken from the table if not given.
    """
    spread = efficiency.select(SOURCE, "revenue_per_install_usd", "rpi_std")
    if median_spread is None:
        median_spread = quantiles(spread, {"median": ("rpi_std", 0.5)}).scalar()
    return best_first(
        null_safe_left(ltv, spread, [SOURCE]).withColumns(
            {
                "recommendation": F.when(F.col(SOURCE).isin(*scale), SCALE)
                .when(F.col(SOURCE).isin(*trim), TRIM)
                .otherwise(MAINTAIN),
                "caution": F.when(F.col("rpi_std") >= median_spread, VOLATILE).otherwise(STABLE),
            }
        )
    )


def summary_q5(recommendation: DataFrame) -> DataFrame:
    return recommendation.select(
        SOURCE, "installs", "ltv_90_usd", "revenue_per_install_usd", "recommendation", "caution"
    )


def experiment_trend(results: DataFrame) -> DataFrame:
    """Installs per week of treatment and control cells, ordered for a line per group."""
    return results.select("group", "week", "installs", "geo_cell").orderBy(
        F.asc_nulls_last("group"), F.asc_nulls_last("week"), F.asc_nulls_last("geo_cell")
    )
