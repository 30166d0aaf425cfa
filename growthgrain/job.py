"""Command line of the two reports, for ``spark-submit``.

    job.py marketing --profiles P --payments P --activity P --out FOLDER
    job.py subscriptions --subscriptions P --out FOLDER

Inputs are Parquet, or CSV where the path ends in ``.csv``; ``--input-format`` names one.
With ``--skip-unreadable`` rows of CSV whose fields are not of their type are left out and
counted, else they fail the report. The tables are published together; their places are
printed, and named by the manifest in the folder.
"""

import argparse
from collections.abc import Sequence
from functools import partial

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql.types import StructType

from growthgrain import schemas
from growthgrain.catalog import SUBSCRIPTION_QUERIES
from growthgrain.plans.frames import GrowthFrames
from growthgrain.plans.report import write_report
from growthgrain.plans.subscriptions import ALL_TYPES, subscription_trend
from growthgrain.session import configure
from growthgrain.sources.published import publish
from growthgrain.sources.tables import (
    read_csv_counted,
    read_optional_csv,
    read_table,
    table_kind,
    write_csv,
    write_parquet,
)

# Fixed value: where filled-in experiment results are looked for, below the output folder.
EXPERIMENT_RESULTS = "q4_experiment_results_filled.csv"


Counts = dict[str, Observation]


def _input(
    spark: SparkSession, args: argparse.Namespace, name: str, schema: StructType, counts: Counts
) -> DataFrame:
    path = getattr(args, name)
    if args.skip_unreadable and table_kind(path, args.input_format) == "csv":
        rows, counts[name] = read_csv_counted(spark, path, schema)
        return rows
    return read_table(spark, path, schema, args.input_format)


def rejects_text(name: str, counted: dict[str, int]) -> str:
    """What was left out of a table, in one line."""
    columns = {c.removeprefix("unreadable_"): n for c, n in counted.items() if c.startswith("unreadable_")}
    by_column = "".join(f", {c} {n}" for c, n in columns.items() if n)
    return f"{name}: {counted['rejected']} of {counted['rows']} rows left out{by_column}"


def marketing(spark: SparkSession, args: argparse.Namespace) -> list[str]:
    counts: Counts = {}
    frames = GrowthFrames(
        _input(spark, args, "profiles", schemas.PROFILES, counts),
        _input(spark, args, "payments", schemas.PAYMENTS, counts),
        _input(spark, args, "activity", schemas.ACTIVITY, counts),
    )
    channels = {"scale": args.scale, "trim": args.trim}
    results = args.experiment or f"{args.out}/{EXPERIMENT_RESULTS}"
    experiment = read_optional_csv(spark, results, schemas.EXPERIMENT_RESULTS)
    written = write_report(
        frames,
        args.out,
        experiment,
        as_csv=args.format == "csv",
        channels={k: v for k, v in channels.items() if v is not None},
    )
    return [*written.values(), *[rejects_text(name, c.get) for name, c in counts.items()]]


def subscriptions(spark: SparkSession, args: argparse.Namespace) -> list[str]:
    counts: Counts = {}
    table = _input(spark, args, "subscriptions", schemas.SUBSCRIPTIONS, counts)
    write = write_csv if args.format == "csv" else write_parquet
    trend = partial(
        subscription_trend, subscription_type=args.type, start=args.start, end=args.end
    )
    tables = SUBSCRIPTION_QUERIES | {"subscription_trend": trend}

    def write_all(folder: str) -> list[str]:
        for name, query in tables.items():
            write(query(table), f"{folder}/{name}")
        return list(tables)

    written = publish(spark, args.out, write_all)
    return [*written.values(), *[rejects_text(name, c.get) for name, c in counts.items()]]


def _month(text: str) -> tuple[int, int]:
    year, month = map(int, text.split("-"))
    if not 1 <= month <= 12:
        raise ValueError(text)
    return year, month


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(description="Growth and subscription reports")
    reports = top.add_subparsers(required=True)
    growth = reports.add_parser("marketing")
    growth.set_defaults(run=marketing)
    for table in ("profiles", "payments", "activity"):
        growth.add_argument(f"--{table}", required=True)
    growth.add_argument("--experiment", help="CSV of experiment results; skipped if absent")
    growth.add_argument("--scale", nargs="*", help="channels to recommend for growth")
    growth.add_argument("--trim", nargs="*", help="channels to recommend for trimming")
    monthly = reports.add_parser("subscriptions")
    monthly.set_defaults(run=subscriptions)
    monthly.add_argument("--subscriptions", required=True)
    monthly.add_argument("--type", default=ALL_TYPES, help="type of the trend, all by default")
    monthly.add_argument("--start", type=_month, help="first month of the trend, YYYY-MM")
    monthly.add_argument("--end", type=_month, help="last month of the trend, YYYY-MM")
    for report in (growth, monthly):
        report.add_argument("--input-format", choices=["csv", "parquet"])
        report.add_argument("--skip-unreadable", action="store_true")
        report.add_argument("--out", required=True)
        report.add_argument("--format", choices=["csv", "parquet"], default="csv")
    return top


def main(arguments: Sequence[str] | None = None) -> None:
    args = parser().parse_args(arguments)
    spark = configure(SparkSession.builder.appName("growthgrain")).getOrCreate()
    for line in args.run(spark, args):
        print(line)


if __name__ == "__main__":
    main()
