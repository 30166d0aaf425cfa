"""The three conformed frames as tables bucketed by profile, written load by load.

Writing a load costs one shuffle per table. From then on every query over the tables joins
and groups on the profile within a bucket, without moving payments or activity. A profile
has at most one row per day and load in them, so a profile with many raw rows does not
swell its bucket. Payment days lie in folders by month and active days in folders by
stretch, so queries on the first 90 days of a life leave out the files before the first
profile and after the last one's days.

A load counts once it is registered, which is the last thing written: a load that fails on
the way, and a second writing of one that is there, change nothing.
"""

import datetime as dt
from uuid import uuid4

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from growthgrain.functions.columns import LAST_LIFECYCLE_DAY, utc_day
from growthgrain.functions.daybits import stretch_of
from growthgrain.operators.dedup import first_row_by
from growthgrain.operators.keys import KEY
from growthgrain.plans.frames import PROFILE_COLUMNS, GrowthFrames, bookings_per_day
from growthgrain.sources.tables import save_bucketed, save_small

DIM, BOOKINGS, ACTIVITY, LOADS = "profile_dim", "booking_days", "activity_stretches", "loads"
#: The part of a table that a row's file lies in, and the load it came with.
PERIOD, BATCH = "period", "batch"
FIRST_LOAD = "first"


def _parts(frames: GrowthFrames, profiles: bool) -> dict[str, DataFrame]:
    found = {
        BOOKINGS: frames.booking_days.withColumn(PERIOD, F.trunc("reported_date", "month")),
        ACTIVITY: frames.activity_stretches.withColumn(PERIOD, F.col("stretch")),
    }
    if profiles:
        found[DIM] = frames.dim.select(KEY, *PROFILE_COLUMNS, "n_profile_rows")
    return found


def _path(prefix: str, table: str, folder: str | None) -> str | None:
    return folder and f"{folder}/{prefix}_{table}"


def _stored(spark: SparkSession, prefix: str, table: str, folder: str | None) -> DataFrame:
    name = f"{prefix}_{table}"
    if folder is not None and not spark.catalog.tableExists(name):
        return spark.read.parquet(f"{folder}/{name}")
    return spark.table(name)


def _write(
    frames: GrowthFrames, prefix: str, buckets: int, folder: str | None, load_id: str, append: bool, profiles: bool
) -> None:
    batch = uuid4().hex
    for table, rows in _parts(frames, profiles).items():
        period = None if table == DIM else PERIOD
        path = _path(prefix, table, folder)
        marked = rows.withColumn(BATCH, F.lit(batch))
        save_bucketed(marked, f"{prefix}_{table}", buckets, path, append, period)
    _register(frames.profiles.sparkSession, prefix, folder, [(load_id, batch)], append)


def _register(
    spark: SparkSession, prefix: str, folder: str | None, rows: list[tuple], append: bool
) -> None:
    loads = spark.createDataFrame(rows, f"load_id string, {BATCH} string")
    save_small(loads, f"{prefix}_{LOADS}", _path(prefix, LOADS, folder), append)


def save_conformed(
    frames: GrowthFrames, prefix: str, buckets: int, folder: str | None = None
) -> None:
    """Write the tables ``<prefix>_profile_dim``, ``_booking_days``, ``_activity_stretches``
    and ``_loads`` anew, from a first load.

    Choose ``buckets`` so that one bucket of the largest table fits a task; all three
    must have the same number. Tables go to ``folder``, or else to the warehouse.
    """
    _register(frames.profiles.sparkSession, prefix, folder, [], append=False)
    _write(frames, prefix, buckets, folder, FIRST_LOAD, append=False, profiles=True)


def append_load(
    new: GrowthFrames,
    prefix: str,
    buckets: int,
    load_id: str,
    folder: str | None = None,
    profiles: bool = True,
) -> bool:
    """Add new profile rows, payments and activity to tables that exist; nothing stored is
    rewritten. False, and nothing is written, if there is a load of that name.

    Each raw row must be in one load only. ``folder`` and ``buckets`` are those of the tables.
    """
    loads = _stored(new.profiles.sparkSession, prefix, LOADS, folder)
    if not loads.where(F.col("load_id") == load_id).isEmpty():
        return False
    _write(new, prefix, buckets, folder, load_id, append=True, profiles=profiles)
    return True


def append_facts(
    new: GrowthFrames, prefix: str, buckets: int, folder: str | None = None
) -> None:
    """Add new payments and activity alone, under a load name of their own."""
    append_load(new, prefix, buckets, uuid4().hex, folder, profiles=False)


def _merged_profiles(rows: DataFrame) -> DataFrame:
    """The first row of each profile over all loads, in its bucket; a profile with two rows
    in one load fails the query."""
    first, loads = first_row_by(PROFILE_COLUMNS), F.size(F.collect_set(BATCH))
    message = F.concat(F.lit("more than one row for "), F.to_json(F.struct(KEY)))
    counted = F.when(F.col("_rows") == F.col("_loads"), F.col("n_profile_rows"))
    return (
        rows.groupBy(KEY)
        .agg(
            first.alias("first"),
            F.sum("n_profile_rows").alias("n_profile_rows"),
            F.count("*").alias("_rows"),
            loads.alias("_loads"),
        )
        .withColumn("n_profile_rows", counted.otherwise(F.raise_error(message)))
        .where("n_profile_rows is not null")
        .select(KEY, *[f"first.{c}" for c in PROFILE_COLUMNS], "n_profile_rows")
        .transform(lambda d: d.withColumn("first_activity_date", utc_day(d, "first_activity_time")))
    )


def _between(first: Column, last: Column) -> Column:
    return F.col(PERIOD).between(first, last)


def load_conformed(
    spark: SparkSession, prefix: str, raw: GrowthFrames, folder: str | None = None
) -> GrowthFrames:
    """Frames over the loads registered now; ``raw`` still serves the row-level queries.

    First profile rows, days and stretches of several loads are added up within their
    bucket; a profile that is stored twice in a load fails the query. The names of the
    loads and the first and last day that a profile starts on reach the driver. With
    ``folder``, a session whose catalog does not know the tables reads their files,
    without the buckets.
    """
    loads = _stored(spark, prefix, LOADS, folder).groupBy("load_id").agg(F.min(BATCH).alias(BATCH))
    batches = [row[BATCH] for row in loads.collect()]
    if not batches:
        raise ValueError(f"no load of {prefix} is complete")
    dim, bookings, activity = (
        _stored(spark, prefix, table, folder).where(F.col(BATCH).isin(batches))
        for table in (DIM, BOOKINGS, ACTIVITY)
    )
    start = utc_day(dim, "first_activity_time")
    begin, end = dim.agg(F.min(start), F.max(start)).first()
    if begin is not None:
        begin, end = F.lit(begin), F.lit(end + dt.timedelta(LAST_LIFECYCLE_DAY))
        in_life = bookings.where(_between(F.trunc(begin, "month"), end))
        activity = activity.where(_between(stretch_of(begin), stretch_of(end)))
    else:
        in_life, activity = bookings.where("false"), activity.where("false")
    days = bookings_per_day(bookings)
    stretches = activity.groupBy(KEY, "stretch").agg(F.bit_or("days").alias("days"))
    return raw.with_ready(
        trusted=True,
        dim=_merged_profiles(dim),
        bookings=days,
        booking_days=days,
        life_days=bookings_per_day(in_life),
        activity_stretches=stretches,
    )
