"""Every query by name, bound to the frames it needs."""

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from growthgrain.plans import feeds, ltv, profiles, recommend, retention, segments
from growthgrain.plans import subscriptions as subs
from growthgrain.plans.frames import GrowthFrames, segments_of

Marketing = Callable[[GrowthFrames], DataFrame]
Subscription = Callable[[DataFrame], DataFrame]


def _ltv_model(f: GrowthFrames) -> DataFrame:
    return ltv.ltv_model(f.ltv_90, ltv.retention_30_37(f.activity_life))


def _summary(f: GrowthFrames) -> DataFrame:
    return retention.retention_channel_summary(f.cohort_retention_revenue)


def _weighted(f: GrowthFrames) -> DataFrame:
    return retention.retention_platform_weighted(f.retention_weekly)


def _rpu(f: GrowthFrames) -> DataFrame:
    return retention.weekly_rpu(f.dim, f.booking_life)


def _efficiency(f: GrowthFrames) -> DataFrame:
    return segments.channel_efficiency(f.segments)


def _efficiency_per_country(f: GrowthFrames) -> DataFrame:
    return segments.channel_efficiency_per_country(f.segments)


def _value(f: GrowthFrames) -> tuple[DataFrame, DataFrame]:
    """LTV by channel and segments, both from one reading of the payments."""
    if {"ltv_90", "segments"} <= f.ready.keys():
        return f.ltv_90, f.segments
    return ltv.ltv_of(f.profile_value), segments_of(f.profile_value)


def recommendation(f: GrowthFrames, **channels) -> DataFrame:
    channel_ltv, by_segment = _value(f)
    # every spread as written is 0, and so is their median
    return recommend.channel_recommendation(
        channel_ltv,
        segments.channel_efficiency(by_segment),
        median_spread=F.lit(0.0),
        **channels,
    )


def recommendation_per_country(f: GrowthFrames, **channels) -> DataFrame:
    channel_ltv, by_segment = _value(f)
    return recommend.channel_recommendation(
        channel_ltv, segments.channel_efficiency_per_country(by_segment), **channels
    )


MARKETING_QUERIES: dict[str, Marketing] = {
    # profiles
    "profile_dim": lambda f: profiles.profile_dim(f.dim),
    "profile_conflicts": lambda f: profiles.profile_conflicts(f.dim),
    "profile_conflicts_detected": lambda f: profiles.profile_conflicts_detected(f.profiles),
    "payments_enriched": lambda f: profiles.payments_enriched(f.payments, f.dim),
    "payments_90": lambda f: profiles.payments_90(f.payments, f.dim),
    "activity_enriched": lambda f: profiles.activity_enriched(f.activity, f.dim),
    "cohort_base": lambda f: profiles.cohort_base(f.dim),
    "activity_lifecycle": lambda f: profiles.activity_lifecycle(f.activity, f.dim),
    # segments and channels
    "installs_by_segment": lambda f: segments.installs_by_segment(f.dim),
    "revenue_by_segment": lambda f: segments.revenue_by_segment(f.segments),
    "segment_rpi": lambda f: segments.segment_rpi(f.segments),
    "install_correlations": lambda f: segments.install_correlations(f.segments),
    "channel_efficiency": _efficiency,
    "channel_efficiency_per_country": _efficiency_per_country,
    "segment_thresholds": lambda f: segments.segment_thresholds(f.segments),
    "segment_anomalies": lambda f: segments.segment_anomalies(f.segments),
    "payer_rate_by_segment": lambda f: segments.payer_rate_by_segment(f.segments),
    "segment_enhanced": lambda f: segments.segment_enhanced(f.segments, f.dim),
    "channel_efficiency_enhanced": lambda f: segments.with_rpi_cv(_efficiency(f)),
    "channel_efficiency_enhanced_per_country": lambda f: segments.with_rpi_cv(
        _efficiency_per_country(f)
    ),
    "channel_rank": lambda f: segments.channel_rank(_efficiency(f)),
    "payer_rate_by_channel": lambda f: segments.payer_rate_by_channel(f.segments),
    "top_segments": lambda f: segments.top_segments(segments.segment_rpi(f.segments)),
    # lifetime value
    "payers_90": lambda f: ltv.payers_90(f.booking_life),
    "installs_by_channel": lambda f: ltv.installs_by_channel(f.dim),
    "ltv_90": lambda f: f.ltv_90,
    "retention_30_37": lambda f: ltv.retention_30_37(f.activity_life),
    "ltv_model": _ltv_model,
    "ltv_regression": lambda f: ltv.ltv_regression(_ltv_model(f)),
    "ltv_rank": lambda f: ltv.ltv_rank(f.ltv_90),
    "cumulative_ltv_curve": lambda f: ltv.cumulative_ltv_curve(f.dim, f.booking_life),
    "ltv_drivers": lambda f: ltv.ltv_drivers(f.ltv_90),
    # cohorts
    "cohort_sizes": lambda f: retention.cohort_sizes(f.dim),
    "retention_weekly": lambda f: f.retention_weekly,
    "payments_weekly": lambda f: retention.payments_weekly(f.booking_life),
    "cohort_retention_revenue": lambda f: f.cohort_retention_revenue,
    "retention_channel_summary": _summary,
    "retention_ios_android": lambda f: retention.retention_ios_android(_summary(f)),
    "retention_platform_weighted": _weighted,
    "retention_platform_week1plus": lambda f: retention.retention_platform_week1plus(_weighted(f)),
    "weekly_rpu": _rpu,
    "weekly_rpu_platform": lambda f: retention.weekly_rpu_platform(_rpu(f)),
    "week1_scorecard": lambda f: retention.week1_scorecard(_summary(f)),
    "retention_curve_platform": lambda f: retention.retention_curve_platform(f.retention_weekly),
    "arpru_platform": lambda f: retention.arpru_platform(f.cohort_retention_revenue),
    "week1_channel_platform": lambda f: retention.week1_channel_platform(_summary(f)),
    "retention_heatmap": lambda f: retention.retention_heatmap(f.retention_weekly),
    # recommendation and summaries
    "channel_recommendation": recommendation,
    "channel_recommendation_per_country": recommendation_per_country,
    "summary_q1": lambda f: segments.summary_q1(_efficiency(f)),
    "summary_q2": lambda f: ltv.summary_q2(f.ltv_90),
    "summary_q3": lambda f: retention.summary_q3(retention.week1_scorecard(_summary(f))),
    "summary_q5": lambda f: recommend.summary_q5(recommendation(f)),
    # chart feeds that are not simply one of the tables above
    "feed_top_installs": lambda f: feeds.bar_feed(
        segments.top_segments(segments.installs_by_segment(f.dim)), "segment", "installs"
    ),
    "feed_channel_rpi": lambda f: feeds.bar_feed(
        _efficiency(f), "acquisition_source", "revenue_per_install_usd"
    ),
    # the spread as written is 0 for every channel, so payments need not be read
    "feed_channel_volatility": lambda f: feeds.bar_feed(
        ltv.installs_by_channel(f.dim).withColumn("rpi_std", F.lit(0.0)),
        "acquisition_source",
        "rpi_std",
    ),
    "feed_payer_rate": lambda f: feeds.bar_feed(
        segments.payer_rate_by_channel(f.segments), "acquisition_source", "payer_rate"
    ),
    "feed_ltv_90": lambda f: feeds.bar_feed(f.ltv_90, "acquisition_source", "ltv_90_usd"),
    "feed_installs_vs_rpi": lambda f: feeds.log_feed(
        segments.segment_rpi(f.segments),
        "installs",
        "revenue_per_install_usd",
        *segments.SEGMENT,
    ),
    "feed_ltv_vs_installs": lambda f: feeds.log_feed(
        f.ltv_90, "installs", "ltv_90_usd", "acquisition_source"
    ),
    # the recommendation's own columns are not drawn, so its joins are left out
    "feed_channel_value_vs_scale": lambda f: feeds.log_feed(
        f.ltv_90, "installs", "ltv_90_usd", "acquisition_source"
    ),
}

SUBSCRIPTION_QUERIES: dict[str, Subscription] = {
    "current_subscriptions": subs.current_subscriptions,
    "most_popular_type": subs.most_popular_type,
    "months_tracked": subs.months_tracked,
    "subscription_trend": subs.subscription_trend,
    "net_change_by_year": subs.net_change_by_year,
    "net_change_pivot": subs.net_change_pivot,
    "selector_types": subs.selector_types,
    "selector_years": subs.selector_years,
    "selector_months": subs.selector_months,
}
