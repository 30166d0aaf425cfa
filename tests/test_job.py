"""The command line, from CSV in to CSV out."""

from growthgrain.job import main
from growthgrain.plans.report import EXPERIMENT_FEED
from growthgrain.sources.published import published
from growthgrain.sources.tables import write_csv


def test_marketing_job(spark, frames, tmp_path, capsys):
    paths = []
    for table in ("profiles", "payments", "activity"):
        write_csv(getattr(frames, table), str(tmp_path / f"{table}.csv"))
        paths += [f"--{table}", str(tmp_path / f"{table}.csv")]
    out = tmp_path / "out"
    main(["marketing", *paths, "--out", str(out)])
    printed = capsys.readouterr().out
    assert published(spark, str(out))["ltv_90_by_channel"] in printed.splitlines()
    written = spark.read.csv(published(spark, str(out))["ltv_90_by_channel"], header=True)
    assert [(r["acquisition_source"], r["payers_90"]) for r in written.collect()] == [
        ("src_1", "2"),
        ("src_2", "2"),
        ("NA", "0"),
    ]
    assert EXPERIMENT_FEED not in printed

    (out / "q4_experiment_results_filled.csv").write_text(
        "geo_cell,group,week,spend_meta,installs,revenue_90_proxy,payer_rate,retention_w1\n"
        "c1,treatment,2,1,9,1,0.1,0.2\nc1,control,1,1,7,1,0.1,0.2\n"
    )
    main(["marketing", *paths, "--out", str(out)])
    feed = spark.read.csv(published(spark, str(out))[EXPERIMENT_FEED], header=True).collect()
    assert [(r["group"], r["installs"]) for r in feed] == [("control", "7.0"), ("treatment", "9.0")]


def test_subscription_job(spark, subscriptions, tmp_path):
    write_csv(subscriptions, str(tmp_path / "subscriptions.csv"))
    main(
        [
            "subscriptions",
            "--subscriptions",
            str(tmp_path / "subscriptions.csv"),
            "--out",
            str(tmp_path / "out"),
            "--format",
            "parquet",
        ]
    )
    total = spark.read.parquet(published(spark, str(tmp_path / "out"))["current_subscriptions"]).first()
    assert total["total_text"] == "1,535"


def test_rejects_are_printed(spark, frames, tmp_path, capsys):
    paths = []
    for table in ("profiles", "activity"):
        write_csv(getattr(frames, table), str(tmp_path / f"{table}.csv"))
        paths += [f"--{table}", str(tmp_path / f"{table}.csv")]
    lines = ["profile_id,reported_date,gross_bookings_usd", "p1,2024-01-07,10", "p1,07/01/2024,x", "p2,2024-01-20,y"]
    (tmp_path / "payments.csv").write_text("\n".join(lines) + "\n")
    out = str(tmp_path / "out")
    arguments = ["marketing", *paths, "--payments", str(tmp_path / "payments.csv"), "--out", out]
    main([*arguments, "--skip-unreadable"])
    printed = capsys.readouterr().out.splitlines()
    assert "payments: 2 of 3 rows left out, reported_date 1, gross_bookings_usd 2" in printed
    assert "profiles: 0 of 8 rows left out" in printed and "activity: 0 of 11 rows left out" in printed
    before = published(spark, out)
    try:
        main(arguments)
    except Exception as error:
        assert "reported_date is not a date" in str(error) or "gross_bookings_usd is not a double" in str(error)
    else:
        raise AssertionError("the unreadable row went unnoticed")
    assert published(spark, out) == before
    assert spark.read.csv(before["ltv_90_by_channel"], header=True).count() == 3
