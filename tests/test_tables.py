"""Readers, writers, the report and the conformed tables."""

import datetime as dt
import gzip
from pathlib import Path

import pytest
from pyspark.errors import AnalysisException

from pyspark.sql import functions as F

from growthgrain import MARKETING_QUERIES, GrowthFrames
from growthgrain.plans.report import EXPERIMENT_FEED, OUTPUTS, write_report
from growthgrain.schemas import (
    ACTIVITY,
    EXPERIMENT_RESULTS,
    PAYMENTS,
    PROFILES,
    SUBSCRIPTIONS,
    WEEKLY_SCORECARD,
)
from growthgrain.schemas import experiment_results_template, weekly_scorecard_template
from growthgrain.session import shared_folder
from growthgrain.sources.conformed import append_facts, append_load, load_conformed, save_conformed
from growthgrain.sources.published import publish, published
from growthgrain.sources.tables import (
    read_csv,
    read_csv_counted,
    read_csv_with_rejects,
    read_optional_csv,
    read_parquet,
    read_table,
    write_csv,
    write_parquet,
)


def test_csv_keeps_ids_and_reads_missing_values(spark, tmp_path):
    path = tmp_path / "profiles.csv"
    path.write_text(
        "first_activity_time,acquisition_source,age,signup_country_code,signup_platform,profile_id\n"
        "2024-01-07T23:30:00Z,src_1,7,NA,iOS,0012\n"
        ',"",8, US ,,0013\n'
    )
    found = read_csv(spark, str(path), PROFILES).orderBy("profile_id").collect()
    assert found[0]["profile_id"] == "0012" and found[0]["signup_country_code"] is None
    moment = found[0]["first_activity_time"].astimezone(dt.timezone.utc)
    assert moment == dt.datetime(2024, 1, 7, 23, 30, tzinfo=dt.timezone.utc)
    assert found[1][1:] == (None, "US", None, None)


PAYMENT_LINES = "profile_id,reported_date,gross_bookings_usd\n"


@pytest.mark.parametrize("line", ["p1,03/01/2024,5", 'p1,2024-03-01,"1,000.00"', "p1,2024-03-01"])
def test_csv_with_an_unreadable_field_is_refused(spark, tmp_path, line):
    path = tmp_path / "payments.csv"
    path.write_text(PAYMENT_LINES + f"p0,2024-01-01,1.5\n{line}\n")
    with pytest.raises(Exception):
        read_csv(spark, str(path), PAYMENTS).collect()


def test_unreadable_rows_can_be_kept_apart(spark, tmp_path):
    path = tmp_path / "payments.csv"
    path.write_text(PAYMENT_LINES + 'p0,2024-01-01,1.5\np1,03/01/2024,"1,000.00"\np2,NA,\n')
    good, rejects = read_csv_with_rejects(spark, str(path), PAYMENTS)
    assert good.schema == PAYMENTS and [r[0] for r in good.orderBy("profile_id").collect()] == ["p0", "p2"]
    assert [tuple(r) for r in rejects.collect()] == [
        ("p1", "03/01/2024", "1,000.00", ["reported_date", "gross_bookings_usd"])
    ]


def test_the_format_is_named_or_seen_from_the_path(spark, frames, tmp_path):
    write_csv(frames.payments, str(tmp_path / "payments"))
    found = read_table(spark, str(tmp_path / "payments"), PAYMENTS, "csv")
    assert found.count() == frames.payments.count()
    (tmp_path / "p.csv.gz").write_bytes(gzip.compress((PAYMENT_LINES + "p0,2024-01-01,1.5\n").encode()))
    assert read_table(spark, str(tmp_path / "p.csv.gz"), PAYMENTS).count() == 1
    write_parquet(frames.payments, str(tmp_path / "parquet"))
    assert read_table(spark, str(tmp_path / "parquet"), PAYMENTS).count() == found.count()


def test_csv_without_a_needed_column_is_refused(spark, tmp_path):
    path = tmp_path / "profiles.csv"
    path.write_text("profile_id\np1\n")
    with pytest.raises(AnalysisException):
        read_csv(spark, str(path), PROFILES)


def test_csv_round_trip(spark, subscriptions, tmp_path):
    with_gap = subscriptions.unionByName(
        spark.createDataFrame([(dt.date(2025, 1, 1), None, None)], SUBSCRIPTIONS)
    )
    write_csv(with_gap, str(tmp_path / "out"))
    text = "".join(p.read_text() for p in (tmp_path / "out").glob("*.csv"))
    assert "2025-01-01,NA,NA" in text
    back = read_csv(spark, str(tmp_path / "out"), SUBSCRIPTIONS)
    assert back.exceptAll(with_gap).count() == 0 and with_gap.exceptAll(back).count() == 0


def test_parquet_round_trip(spark, subscriptions, tmp_path):
    write_parquet(subscriptions, str(tmp_path / "out"))
    back = read_parquet(spark, str(tmp_path / "out"), SUBSCRIPTIONS)
    assert back.exceptAll(subscriptions).count() == 0 and back.count() == subscriptions.count()


def test_ordered_csv_keeps_its_order(spark, frames, tmp_path):
    write_csv(MARKETING_QUERIES["ltv_rank"](frames), str(tmp_path / "out"))
    lines = [
        line
        for part in sorted((tmp_path / "out").glob("part-*.csv"))
        for line in part.read_text().splitlines()[1:]
    ]
    assert [line.split(",")[0] for line in lines] == ["1", "2", "3"]


def test_optional_source(spark, tmp_path):
    assert read_optional_csv(spark, str(tmp_path / "absent.csv"), EXPERIMENT_RESULTS) is None
    path = tmp_path / "results.csv"
    path.write_text(",".join(EXPERIMENT_RESULTS.names) + "\ncell,control,3,1.5,20,NA,,0.1\n")
    row = read_optional_csv(spark, str(path), EXPERIMENT_RESULTS).first()
    assert tuple(row) == ("cell", "control", 3, 1.5, 20.0, None, None, 0.1)


def test_templates_are_empty(spark):
    assert experiment_results_template(spark).schema == EXPERIMENT_RESULTS
    assert weekly_scorecard_template(spark).schema == WEEKLY_SCORECARD
    assert weekly_scorecard_template(spark).count() == 0


def test_report_writes_every_table(spark, frames, tmp_path):
    results = spark.createDataFrame(
        [("c1", "control", 1, 1.0, 5.0, 1.0, 0.1, 0.2)], EXPERIMENT_RESULTS
    )
    names = write_report(frames, str(tmp_path), experiment=results)
    assert len(names) == len(set(names)) == 29 and EXPERIMENT_FEED in names
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("report_")]
    assert not list(Path(spark.conf.get("spark.sql.warehouse.dir").removeprefix("file:")).glob("report_*"))
    for name in names:
        assert list(Path(names[name]).glob("part-*.csv")), name
    assert published(spark, str(tmp_path)) == names
    without = write_report(frames, str(tmp_path / "parquet"), as_csv=False)
    assert EXPERIMENT_FEED not in without
    for name, query in OUTPUTS.items():
        written = spark.read.parquet(without[name])
        direct = MARKETING_QUERIES[query](frames)
        if query != "ltv_regression":
            assert sorted(map(str, written.collect())) == sorted(map(str, direct.collect())), name


def test_a_writing_that_fails_changes_nothing_for_readers(spark, tmp_path):
    folder = str(tmp_path)
    assert published(spark, folder) == {}

    def write(number, fail):
        def write_all(below):
            write_parquet(spark.range(number), f"{below}/one")
            if fail:
                raise RuntimeError("half way")
            write_parquet(spark.range(number), f"{below}/two")
            return ["one", "two"]

        return write_all

    publish(spark, folder, write(3, False))
    with pytest.raises(RuntimeError):
        publish(spark, folder, write(5, True))
    assert {n: spark.read.parquet(p).count() for n, p in published(spark, folder).items()} == {"one": 3, "two": 3}
    publish(spark, folder, write(7, False))
    assert {n: spark.read.parquet(p).count() for n, p in published(spark, folder).items()} == {"one": 7, "two": 7}


def test_conformed_tables_give_the_same_results_without_moving_facts(spark, frames):
    save_conformed(frames, "growth", 4)
    loaded = load_conformed(spark, "growth", frames)
    for query in ["segment_rpi", "ltv_90", "cohort_retention_revenue", "payer_rate_by_segment"]:
        expected = sorted(map(str, MARKETING_QUERIES[query](frames).collect()))
        assert sorted(map(str, MARKETING_QUERIES[query](loaded).collect())) == expected
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for life in (loaded.booking_life, loaded.activity_life):
            plan = life._jdf.queryExecution().executedPlan().toString()
            assert "SortMergeJoin" in plan and "Exchange" not in plan
            assert "PartitionFilters: [" in plan and "period" in plan
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_facts_can_be_appended(spark, frames, tmp_path):
    """Payments and activity in two loads give what one load gives."""
    loads = []
    for part in (0, 1):
        mine = F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(2)) == part
        loads.append(
            GrowthFrames(frames.profiles, frames.payments.where(mine), frames.activity.where(mine))
        )
    folder = f"file://{tmp_path}/tables"
    save_conformed(loads[0], "loads", 4, folder)
    append_facts(loads[1], "loads", 4, folder)
    loaded = load_conformed(spark, "loads", frames, folder)
    other = load_conformed(spark.newSession(), "loads", frames, folder)
    spark.sql("DROP TABLE loads_profile_dim")
    spark.sql("DROP TABLE loads_booking_days")
    spark.sql("DROP TABLE loads_activity_stretches")
    spark.sql("DROP TABLE loads_loads")
    from_files = load_conformed(spark, "loads", frames, folder)
    for query in ["segment_rpi", "ltv_90", "cohort_retention_revenue"]:
        expected = sorted(map(str, MARKETING_QUERIES[query](frames).collect()))
        assert sorted(map(str, MARKETING_QUERIES[query](from_files).collect())) == expected
    assert loaded.dim.columns == other.dim.columns


LOADED = ["profile_dim", "segment_rpi", "ltv_90", "cohort_retention_revenue", "payer_rate_by_segment"]


def results(frames):
    return {q: sorted(map(str, MARKETING_QUERIES[q](frames).collect())) for q in LOADED}


def test_loads_add_up_to_a_rebuild_and_count_once(spark, frames, tmp_path):
    """Profiles, payments and activity in three loads, one of them written twice and one
    that dies before it is registered."""
    loads = []
    for part in range(3):
        mine = F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(3)) == part
        loads.append(GrowthFrames(*(t.where(mine) for t in (frames.profiles, frames.payments, frames.activity))))
    folder = f"file://{tmp_path}/tables"
    save_conformed(loads[0], "step", 4, folder)
    assert append_load(loads[1], "step", 4, "monday", folder)
    before = results(load_conformed(spark, "step", frames, folder))
    assert not append_load(loads[1], "step", 4, "monday", folder)
    with pytest.raises(Exception, match="lost"):
        broken = loads[2].activity.withColumn("activity_date", F.raise_error(F.lit("lost")).cast("date"))
        append_load(GrowthFrames(loads[2].profiles, loads[2].payments, broken), "step", 4, "tuesday", folder)
    assert results(load_conformed(spark, "step", frames, folder)) == before
    assert append_load(loads[2], "step", 4, "tuesday", folder)
    assert results(load_conformed(spark, "step", frames, folder)) == results(frames)


def files_read(df):
    """Files that the scans of an executed plan opened."""
    found = []

    def walk(node):
        if node.nodeName().startswith("Scan "):
            found.append(node.metrics().apply("numFiles").value())
        inner = node.plan() if "QueryStage" in node.nodeName() else None
        inner = node.executedPlan() if node.nodeName().startswith("AdaptiveSparkPlan") else inner
        for child in [inner] if inner is not None else [node.children().apply(i) for i in range(node.children().size())]:
            walk(child)

    df.collect()
    walk(df._jdf.queryExecution().executedPlan())
    return sum(found)


def test_first_days_of_life_leave_out_files(spark, frames, tmp_path):
    years = [(f"p{i % 5}", dt.date(2010 + i % 30, 1 + i % 12, 3), 1.0) for i in range(600)]
    payments = frames.payments.unionByName(spark.createDataFrame(years, PAYMENTS))
    active = spark.createDataFrame([r[:2] for r in years], ACTIVITY)
    more = GrowthFrames(frames.profiles, payments, frames.activity.unionByName(active))
    save_conformed(more, "pruned", 2)
    loaded = load_conformed(spark, "pruned", more)
    assert results(loaded) == results(more)
    every, some = files_read(loaded.booking_days), files_read(loaded.life_days)
    assert 0 < some < every / 10
    stored = spark.table("pruned_activity_stretches").inputFiles()
    assert 0 < files_read(loaded.activity_stretches) < len(stored) / 5


def test_tables_without_a_complete_load_are_refused(spark, frames, tmp_path):
    folder = f"file://{tmp_path}/tables"
    broken = frames.activity.withColumn("activity_date", F.raise_error(F.lit("lost")).cast("date"))
    with pytest.raises(Exception, match="lost"):
        save_conformed(GrowthFrames(frames.profiles, frames.payments, broken), "begun", 2, folder)
    with pytest.raises(ValueError, match="no load"):
        load_conformed(spark, "begun", frames, folder)


def test_rejects_are_counted_in_the_reading(spark, tmp_path):
    path = tmp_path / "payments.csv"
    path.write_text(PAYMENT_LINES + 'p0,2024-01-01,1.5\np1,03/01/2024,"1,000.00"\np2,NA,\np3,2024-01-01,x\n')
    good, counts = read_csv_counted(spark, str(path), PAYMENTS)
    assert good.schema == PAYMENTS and sorted(r[0] for r in good.collect()) == ["p0", "p2"]
    assert counts.get == {
        "rows": 4, "rejected": 2, "unreadable_profile_id": 0, "unreadable_reported_date": 1,
        "unreadable_gross_bookings_usd": 2,
    }
    assert good.groupBy("profile_id").agg(F.sum("gross_bookings_usd")).count() == 2


def test_a_doubled_profile_fails_the_query(spark, frames):
    doubled = frames.with_ready(dim=frames.dim.unionAll(frames.dim))
    with pytest.raises(Exception, match="more than one row for"):
        MARKETING_QUERIES["installs_by_channel"](doubled).collect()
    spark.sql("DROP TABLE IF EXISTS twice_profile_dim")
    save_conformed(frames.with_ready(trusted=True, dim=frames.dim.unionAll(frames.dim)), "twice", 2)
    with pytest.raises(Exception, match="more than one row for"):
        MARKETING_QUERIES["segment_rpi"](load_conformed(spark, "twice", frames)).collect()


class Context:
    def __init__(self, master, folder=None):
        self.master, self.folder = master, folder

    def getCheckpointDir(self):
        return self.folder

    def setCheckpointDir(self, folder):
        self.folder = folder


class Session:
    def __init__(self, master, folder=None, **conf):
        self.sparkContext, self.conf = Context(master, folder), conf


@pytest.mark.parametrize("master", ["local[2]", "spark://somewhere"])
def test_shared_folder_is_the_one_the_session_names(master):
    assert shared_folder(Session(master, "set")) == "set"
    assert shared_folder(Session(master, None, **{"spark.checkpoint.dir": "named"})) == "named"


def test_only_a_local_session_may_use_a_temporary_folder():
    assert shared_folder(Session("local[2]"))
    with pytest.raises(RuntimeError):
        shared_folder(Session("spark://somewhere"))
