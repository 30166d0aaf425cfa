"""Shape of the physical plans on the sample tables, with broadcasts switched off."""

import re

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from growthgrain import MARKETING_QUERIES, GrowthFrames
from growthgrain.plans.retention import _active_weeks

SAMPLE = "/root/testdata/sf0.001"
# This runs a job while its plan is built; the text operators have plan tests of their own.
NOT_LAZY = {"net_change_pivot"}
TEXT = re.compile(r"op\d+_|pipeline$")


def initial_plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def final_plan(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def no_broadcast(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield spark
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


@pytest.mark.parametrize(
    "name", sorted(n for n in set(entry.queries()) - NOT_LAZY if not TEXT.match(n))
)
def test_no_product_and_no_python(no_broadcast, name):
    plan = initial_plan(entry.queries()[name](no_broadcast, SAMPLE))
    for operator in ("CartesianProduct", "NestedLoopJoin", "BatchEvalPython", "ArrowEvalPython"):
        assert operator not in plan
    assert not re.search(r"Window.*\n(.*Sort.*\n)?.*Exchange SinglePartition", plan)
    assert "Scan parquet" in plan


def test_scans_read_only_needed_columns(spark):
    plan = initial_plan(MARKETING_QUERIES["ltv_90"](entry._frames(spark, SAMPLE)))
    schemas = re.findall(r"ReadSchema: struct<([^>]*)>", plan)
    fields = {f.split(":")[0] for schema in schemas for f in schema.split(",")}
    assert fields == {
        "c_custkey",
        "c_nationkey",
        "c_mktsegment",
        "n_nationkey",
        "n_name",
        "o_custkey",
        "o_orderdate",
        "o_totalprice",
    }


def test_activity_is_reduced_before_it_meets_the_profiles(no_broadcast):
    plan = initial_plan(entry._frames(no_broadcast, SAMPLE).activity_life)
    assert re.search(r"SortMergeJoin \[pk#\d+\], \[pk#\d+\], Inner", plan)
    assert re.search(r"functions=\[partial_bit_or\(", plan)


FACT_EXCHANGES = {
    "ltv_90": ("bookings", 1),
    "cumulative_ltv_curve": ("bookings", 1),
    "weekly_rpu": ("bookings", 1),
    "payments_weekly": ("bookings", 1),
    "retention_weekly": ("days", 2),
}


@pytest.mark.parametrize("name", FACT_EXCHANGES)
def test_exchanges_that_facts_pass(no_broadcast, name):
    """Payments pass one exchange to their profiles; active days are added up first."""
    column, wanted = FACT_EXCHANGES[name]
    frames = entry._frames(no_broadcast, SAMPLE)
    plan = initial_plan(frames.activity_life if column == "days" else frames.booking_life)
    facts = frames.payments if column == "bookings" else frames.activity
    exchanges = re.findall(r"Exchange hashpartitioning\((\w+)#", plan)
    before = re.findall(r"Exchange hashpartitioning\((\w+)#", initial_plan(facts))
    moved = [k for k in exchanges if k in ("spread_key", "pk")]
    if column == "bookings":
        assert moved.count("spread_key") == wanted
    else:
        profiles = initial_plan(frames.dim).count("Exchange hashpartitioning")
        assert len(exchanges) - len(before) - profiles == wanted
    users = initial_plan(MARKETING_QUERIES[name](frames))
    assert users.count("Exchange hashpartitioning(spread_key") <= wanted


@pytest.mark.parametrize("hot_rows", [0, 300, 10**9])
def test_results_do_not_depend_on_which_keys_are_hot(spark, hot_rows):
    sample = entry._touch_frames(spark, SAMPLE)
    frames = GrowthFrames(sample.profiles, sample.payments, sample.activity, hot_rows=hot_rows)
    for name in ("ltv_90", "weekly_rpu", "channel_recommendation_per_country"):
        rows = MARKETING_QUERIES[name](frames).collect()
        assert sorted(map(str, rows)) == sorted(map(str, MARKETING_QUERIES[name](sample).collect()))


def test_counting_users_adds_no_exchange_on_the_profile(no_broadcast):
    frames = entry._frames(no_broadcast, SAMPLE)
    life = initial_plan(frames.activity_life).count("Exchange hashpartitioning")
    users = initial_plan(_active_weeks(frames.activity_life)).count("Exchange hashpartitioning")
    assert users == life


def test_the_profile_dimension_is_shuffled_once(no_broadcast):
    plan = final_plan(MARKETING_QUERIES["ltv_90"](entry._frames(no_broadcast, SAMPLE)))
    final = plan.split("== Initial Plan ==")[0]
    assert re.search(r"ReusedExchange \[pk#\d+, min#\d+\]", final)


def test_thresholds_read_the_same_shuffle_as_the_rows(no_broadcast):
    plan = final_plan(MARKETING_QUERIES["segment_anomalies"](entry._frames(no_broadcast, SAMPLE)))
    assert "ReusedExchange [acquisition_source" in plan


@pytest.mark.parametrize("name", ["touch_payments_enriched", "touch_activity_lifecycle"])
def test_a_profile_with_many_rows_is_split_over_tasks(no_broadcast, name):
    """A fifth of the facts has no profile id; no task of the join gets much more than its share."""
    settings = {
        "spark.sql.adaptive.coalescePartitions.enabled": "false",
        "spark.sql.adaptive.skewJoin.enabled": "false",
        "spark.sql.shuffle.partitions": "64",
    }
    before = {key: no_broadcast.conf.get(key) for key in settings}
    for key, value in settings.items():
        no_broadcast.conf.set(key, value)
    try:
        found = entry.queries()[name](no_broadcast, "/root/testdata/sf0.1")
        missing = found.where("profile_id is null").groupBy(F.spark_partition_id().alias("task")).count()
        sizes = [r["count"] for r in missing.collect()]
        assert len(sizes) == 64 and max(sizes) < 2 * sum(sizes) / 64
    finally:
        for key, value in before.items():
            no_broadcast.conf.set(key, value)


def rows_scanned(node):
    """Rows read from files by an executed plan, by first column read; reuse reads nothing."""
    name = node.nodeName()
    if name.startswith("AdaptiveSparkPlan"):
        return rows_scanned(node.executedPlan())
    if "ReusedExchange" in name:
        return {}
    if "QueryStage" in name:
        return rows_scanned(node.plan())
    if name.startswith("Scan "):
        column = node.output().head().name()
        return {column: node.metrics().apply("numOutputRows").value()}
    found = {}
    for below in (node.children(), node.subqueries()):
        for i in range(below.size()):
            child = below.apply(i)
            if child.nodeName().startswith("ReusedSubquery"):
                continue
            child = child.child() if child.nodeName().startswith("Subquery") else child
            for column, rows in rows_scanned(child).items():
                found[column] = found.get(column, 0) + rows
    return found


READS = {
    "segment_anomalies": (1, 0),
    "segment_enhanced": (1, 0),
    "channel_efficiency_per_country": (1, 0),
    # once whole, and once the ids alone for the sketch of frequent ones
    "ltv_drivers": (2, 0),
    "ltv_model": (2, 1),
    "cohort_retention_revenue": (2, 1),
    # all-time and 90-day revenue side by side
    "channel_recommendation": (1, 0),
    "channel_recommendation_per_country": (1, 0),
    "summary_q5": (1, 0),
    "feed_top_installs": (0, 0),
    "feed_channel_volatility": (0, 0),
    "retention_heatmap": (0, 1),
}


@pytest.mark.parametrize("name", READS)
def test_facts_are_read_once(no_broadcast, tmp_path, name):
    sample = entry._touch_frames(no_broadcast, SAMPLE)
    first = {"profiles": "profile_id", "payments": "paying_id", "activity": "active_id"}
    tables = []
    for table, column in first.items():
        path = str(tmp_path / table)
        getattr(sample, table).withColumnRenamed("profile_id", column).write.parquet(path)
        opened = no_broadcast.read.parquet(path)
        tables.append(opened.withColumnRenamed(column, "profile_id"))
    query = MARKETING_QUERIES[name](GrowthFrames(*tables))
    query.collect()
    read = rows_scanned(query._jdf.queryExecution().executedPlan())
    payments, activity = READS[name]
    # without hot ids the reading for the sketch may be gone from the final plan
    assert read.get("paying_id", 0) in {n * tables[1].count() for n in (payments, min(payments, 1))}
    assert read.get("active_id", 0) == activity * tables[2].count()


BY = {
    "segment_anomalies": ("revenue_per_install_usd", True),
    "channel_efficiency_enhanced": ("revenue_per_install_usd", True),
    "channel_efficiency_enhanced_per_country": ("revenue_per_install_usd", True),
    "channel_rank": ("revenue_per_install_usd", True),
    "summary_q1": ("revenue_per_install_usd", True),
    "payer_rate_by_channel": ("payer_rate", True),
    "top_segments": ("installs", True),
    "ltv_rank": ("ltv_rank", False),
    "ltv_drivers": ("ltv_90_usd", True),
    "summary_q2": ("ltv_90_usd", True),
    "summary_q5": ("ltv_90_usd", True),
    "channel_recommendation": ("ltv_90_usd", True),
    "cumulative_ltv_curve": ("acquisition_source", False),
    "week1_scorecard": ("mean_retention_rate", True),
    "summary_q3": ("mean_retention_rate", True),
    "feed_top_installs": ("installs", False),
    "feed_channel_rpi": ("revenue_per_install_usd", False),
    "feed_payer_rate": ("payer_rate", False),
    "feed_ltv_90": ("ltv_90_usd", False),
    "net_change_by_year": ("year", False),
    "net_change_pivot": ("year", False),
    "selector_years": ("year", False),
    "subscription_trend": ("subscription_type", False),
}


@pytest.mark.parametrize("name", BY)
def test_rows_come_in_order(spark, name):
    column, descending = BY[name]
    values = [r[column] for r in entry.queries()[name](spark, SAMPLE).collect()]
    there = [v for v in values if v is not None]
    assert len(there) > 1 and there == sorted(there, reverse=descending)
    assert values == there + [None] * (len(values) - len(there))
