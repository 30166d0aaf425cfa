"""The whole marketing report: every output table, with each fact table read once."""

import uuid
from collections.abc import Callable, Iterator, Sequence
from concurrent.futures import ThreadPoolExecutor
from contextlib import contextmanager
from functools import partial

from pyspark.sql import DataFrame

from growthgrain.catalog import MARKETING_QUERIES, recommendation
from growthgrain.plans.frames import GrowthFrames
from growthgrain.plans.ltv import best_first
from growthgrain.plans.recommend import experiment_trend, summary_q5
from growthgrain.schemas import experiment_results_template, weekly_scorecard_template
from growthgrain.sources.published import publish
from growthgrain.sources.tables import save_bucketed, write_csv, write_parquet

# Names of the output tables, and the query each one holds.
OUTPUTS = {
    "profile_dimension_conflicts": "profile_conflicts",
    "installs_revenue_rpi_by_channel_country": "segment_rpi",
    "channel_efficiency_volatility_summary": "channel_efficiency",
    "revenue_install_anomalies": "segment_anomalies",
    "channel_country_enhanced_metrics": "segment_enhanced",
    "channel_efficiency_volatility_enhanced": "channel_efficiency_enhanced",
    "q1_correlation_summary": "install_correlations",
    "q1_channel_rank_table": "channel_rank",
    "q1_payer_rate_by_channel": "payer_rate_by_channel",
    "ltv_90_by_channel": "ltv_90",
    "ltv_predictions_by_channel": "ltv_regression",
    "q2_ltv_rank_table": "ltv_rank",
    "q2_cumulative_ltv_curve": "cumulative_ltv_curve",
    "q2_ltv_driver_decomposition": "ltv_drivers",
    "cohort_retention_revenue_weekly": "cohort_retention_revenue",
    "retention_channel_platform_summary": "retention_channel_summary",
    "retention_ios_android_summary": "retention_ios_android",
    "q3_weighted_retention_platform_summary": "retention_platform_weighted",
    "q3_weighted_retention_platform_week1plus": "retention_platform_week1plus",
    "q3_weekly_revenue_per_installed_user": "weekly_rpu",
    "q3_week1_retention_scorecard": "week1_scorecard",
    "q5_channel_recommendation_table": "channel_recommendation",
    "summary_q1": "summary_q1",
    "summary_q2": "summary_q2",
    "summary_q3": "summary_q3",
    "summary_q5": "summary_q5",
}
SORTED_BY_LTV = {"ltv_90_by_channel", "ltv_predictions_by_channel"}
# Names of the two empty tables and of the experiment feed.
RESULTS_TEMPLATE = "q4_experiment_results_template"
SCORECARD_TEMPLATE = "q5_weekly_marketing_scorecard_template"
EXPERIMENT_FEED = "q4_treatment_control_installs"

# Frames several outputs start from; each is built from the ones before it.
SHARED = [
    "dim",
    "booking_days",
    "segments",
    "booking_life",
    "activity_life",
    "ltv_90",
    "retention_weekly",
    "cohort_retention_revenue",
]


@contextmanager
def materialised(frames: GrowthFrames) -> Iterator[GrowthFrames]:
    """Frames read back from tables written once to the warehouse, until the block ends.

    Frames that are ready already, like the bucketed tables, are left where they are.
    All outputs then start from these tables instead of reading the raw facts again,
    survive the loss of executors, and are planned on their true sizes. Payments are
    read once, into one row per profile and day. Profiles and payment days are bucketed
    by profile, so joining them moves neither again.
    """
    spark = frames.profiles.sparkSession
    prefix = f"report_{uuid.uuid4().hex}"
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    written = []
    try:
        for name in [n for n in SHARED if n not in frames.ready]:
            table = f"{prefix}_{name}"
            written.append(table)
            df = getattr(frames, name)
            if name in ("dim", "booking_days"):
                save_bucketed(df, table, buckets)
            else:
                df.write.format("parquet").saveAsTable(table)
            ready = {name: spark.table(table)}
            if name == "booking_days":
                ready["bookings"] = ready[name]
            frames = frames.with_ready(trusted=True, **ready)
        yield frames
    finally:
        for table in written:
            spark.sql(f"DROP TABLE IF EXISTS {table} PURGE")


def _output(name: str, frames: GrowthFrames, channels: dict[str, Sequence[str]]) -> DataFrame:
    query = OUTPUTS[name]
    if query == "channel_recommendation":
        return recommendation(frames, **channels)
    if query == "summary_q5":
        return summary_q5(recommendation(frames, **channels))
    table = MARKETING_QUERIES[query](frames)
    return best_first(table) if name in SORTED_BY_LTV else table


def write_report(
    frames: GrowthFrames,
    folder: str,
    experiment: DataFrame | None = None,
    as_csv: bool = True,
    at_once: int = 4,
    channels: dict[str, Sequence[str]] | None = None,
) -> dict[str, str]:
    """Publish every output in ``folder``; where each one lies, by name.

    Readers of ``published(spark, folder)`` see the outputs before these until all are
    written. The outputs are small once the shared frames are written, so ``at_once`` of them
    run side by side. The experiment feed is written only if results are given.
    ``channels`` are the sources to ``scale`` and to ``trim`` in the recommendation.
    """
    spark = frames.profiles.sparkSession
    write = write_csv if as_csv else write_parquet
    with materialised(frames) as shared, ThreadPoolExecutor(at_once) as pool:
        tables: dict[str, Callable[[], DataFrame]] = {
            name: partial(_output, name, shared, channels or {}) for name in OUTPUTS
        }
        tables[RESULTS_TEMPLATE] = partial(experiment_results_template, spark)
        tables[SCORECARD_TEMPLATE] = partial(weekly_scorecard_template, spark)
        if experiment is not None:
            tables[EXPERIMENT_FEED] = partial(experiment_trend, experiment)

        def write_all(below: str) -> list[str]:
            list(pool.map(lambda name: write(tables[name](), f"{below}/{name}"), tables))
            return list(tables)

        return publish(spark, folder, write_all)
