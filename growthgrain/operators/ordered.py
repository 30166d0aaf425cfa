"""Operators that depend on an order."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window
from pyspark.sql import functions as F


def running_sum(value: Column, keys: list[str], order: str) -> Column:
    """Running total of ``value`` per ``keys`` in ``order``."""
    window = (
        Window.partitionBy(*keys)
        .orderBy(order)
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    return F.sum(value).over(window)


def largest_first(column: str, *ties: str) -> list[Column]:
    """Sort order: biggest first, NULL last, ties by the remaining columns."""
    return [F.desc_nulls_last(column), *[F.asc_nulls_last(t) for t in ties]]


def top_rows(df: DataFrame, order: list[Column], n: int) -> DataFrame:
    """The first ``n`` rows in ``order``; each task keeps only its own best ``n``."""
    return df.orderBy(*order).limit(n)


# Rows of the sample that bounds are taken from, and its rows between two bounds.
SAMPLE, APART = 8192, 8


def _bounds(keyed: DataFrame) -> Column:
    """Sort keys that cut the rows into about a thousand runs, as one ascending array.

    The rows of the smallest hashes are the sample, so it is the same in every run and
    partitioning, and each task keeps no more than its own best.
    """
    sample = top_rows(keyed.select("_key", F.xxhash64("_key").alias("_hash")), [F.col("_hash")], SAMPLE)
    ordered = sample.agg(F.array_sort(F.collect_list("_key")).alias("keys"))
    every = F.filter("keys", lambda _, i: i % APART == APART - 1)
    return ordered.select(F.array_distinct(every)).scalar()


def _run_of(key: Column, bounds: Column) -> Column:
    """How many bounds a key is not below, by halving."""
    steps = F.sequence(F.lit(0), F.lit(SAMPLE.bit_length()))

    def halve(at: Column, _: Column) -> Column:
        middle = F.floor((at["low"] + at["high"]) / 2).cast("int")
        above = F.get(bounds, middle) <= key
        return F.when(at["low"] >= at["high"], at).otherwise(
            F.struct(
                F.when(above, middle + 1).otherwise(at["low"]).alias("low"),
                F.when(above, at["high"]).otherwise(middle).alias("high"),
            )
        )

    begin = F.struct(F.lit(0).alias("low"), F.size(bounds).alias("high"))
    return F.aggregate(steps, begin, halve, lambda at: at["low"])


def _in_runs(keyed: DataFrame) -> DataFrame:
    with_bounds = keyed.withColumn("_bounds", _bounds(keyed))
    return with_bounds.withColumn("_run", _run_of(F.col("_key"), F.col("_bounds"))).drop("_bounds")


def ranked(df: DataFrame, value: str, ties: list[str], name: str) -> DataFrame:
    """``df`` with the position of each row, from 1, by ``value`` and ``ties``.

    The largest value comes first, missing ones last. Rows are cut into runs by bounds on
    value and ties together, numbered within each run, and the sizes of the runs before
    are added; so equal values are numbered by several tasks too, and only rows equal in
    value and all ties stay together.
    """
    parts = [F.col(value).isNull(), -F.col(value).cast("double")]
    for tie in ties:
        parts += [F.col(tie).isNull(), F.col(tie)]
    keyed = df.withColumn("_key", F.struct(*[p.alias(f"k{i}") for i, p in enumerate(parts)]))
    placed = _in_runs(keyed)
    sizes = placed.groupBy("_run").agg(F.count("*").alias("n"))
    each = sizes.agg(F.map_from_entries(F.collect_list(F.struct("_run", "n"))).alias("sizes"))
    start = F.struct(
        F.lit(0).cast("bigint").alias("rows"), F.array().cast("array<bigint>").alias("before")
    )
    before = F.aggregate(
        F.sequence(F.lit(0), F.lit(SAMPLE // APART)),
        start,
        lambda done, run: F.struct(
            (done["rows"] + F.coalesce(F.try_element_at("sizes", run), F.lit(0))).alias("rows"),
            F.array_append(done["before"], done["rows"]).alias("before"),
        ),
        lambda done: done["before"],
    )
    place = F.get(each.select(before).scalar(), F.col("_run"))
    inside = Window.partitionBy("_run").orderBy("_key")
    numbered = placed.withColumn(name, (place + F.row_number().over(inside)).cast("int"))
    return numbered.drop("_key", "_run")


# Ranges of values per doubling, and equal parts that such a range is cut into.
STEPS, PARTS = 16, 65_536
LARGEST_LOG = 1100


def _range_of(value: Column) -> Column:
    """A whole number that rises with the value: 16 steps per doubling, on either side of 0."""

    def step(size: Column) -> Column:
        return (F.floor(F.least(F.log2(size), F.lit(LARGEST_LOG)) * STEPS) + 2 * LARGEST_LOG * STEPS).cast("int")

    return F.when(value > 0, step(value)).when(value < 0, -step(-value)).otherwise(0)


def _part_of(value: Column, low: Column, high: Column) -> Column:
    """The part of the span from ``low`` to ``high`` a value lies in; it rises with the value."""
    return F.floor(F.coalesce(F.try_divide(value - low, high - low), F.lit(0.0)) * PARTS).cast("int")


def _holding(counted: DataFrame, by: str) -> DataFrame:
    """The rows of ``counted`` (``part``, ``n``) that hold the wanted place (``place``) of
    their group, with the place within the row."""
    so_far = Window.partitionBy(by).orderBy("part").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    within = counted.withColumn("place", F.col("place") - F.sum("n").over(so_far) + F.col("n"))
    return within.where((F.col("place") >= 0) & (F.col("place") < F.col("n")))


def _first_spots(values: DataFrame, shares: list[tuple[int, float]]) -> DataFrame:
    """For each wanted place (``which``) the range of values that holds it.

    A quantile lies between two places: number 2 i and, beside it, 2 i + 1.
    """
    counted = values.groupBy("of", _range_of(F.col("x")).alias("part")).agg(
        F.sum("n").alias("n"), F.min("x").alias("low"), F.max("x").alias("high")
    )
    counted = counted.withColumn("all", F.sum("n").over(Window.partitionBy("of")))
    asked = []
    for i, (of, share) in enumerate(shares):
        at = (F.col("all") - 1) * share
        for which, place in ((2 * i, F.floor(at)), (2 * i + 1, F.ceil(at))):
            one = F.struct(F.lit(which).alias("which"), place.alias("place"))
            asked.append(F.when(F.col("of") == of, one))
    every = counted.select("*", F.inline(F.array_compact(F.array(*asked))))
    return _holding(every, "which").select(*SPOT)


SPOT = ["which", "of", "low", "high", "place", "all"]


def _inside(values: DataFrame, spots: DataFrame) -> DataFrame:
    """The values in the spots; there are two spots for each quantile."""
    here = F.broadcast(spots.withColumnRenamed("of", "in"))
    return values.join(here, (F.col("of") == F.col("in")) & F.col("x").between(F.col("low"), F.col("high")))


def _closer(values: DataFrame, spots: DataFrame) -> DataFrame:
    """The part of each spot that holds its place."""
    part = _part_of(F.col("x"), F.col("low"), F.col("high"))
    counted = _inside(values, spots).groupBy("which", part.alias("part")).agg(
        F.sum("n").alias("n"),
        F.min("x").alias("low"),
        F.max("x").alias("high"),
        *[F.max(c).alias(c) for c in ("of", "place", "all")],
    )
    return _holding(counted, "which").select(*SPOT)


def quantiles(df: DataFrame, wanted: dict[str, tuple[str, float]]) -> DataFrame:
    """One row of exact quantiles: for each name a column and a share, interpolated between
    neighbours. Missing values are left out; values are finite; no value gives NULL.

    Equal values are added up first. Counts per range of values tell the range that holds
    a wanted place; that range is cut into equal parts and counted again, and once more,
    after which some 65,000 different doubles at most are left. So no task holds more than
    the counts of one step, however many values there are.
    """
    columns = list(dict.fromkeys(c for c, _ in wanted.values()))
    shares = [(columns.index(c), share) for c, share in wanted.values()]
    each = [F.struct(F.lit(i).alias("of"), F.col(c).cast("double").alias("x")) for i, c in enumerate(columns)]
    values = (
        df.select(F.inline(F.array(*each)))
        .where("x is not null")
        .groupBy("of", (F.col("x") + 0.0).alias("x"))
        .agg(F.count("*").alias("n"))
    )
    spots = _closer(values, _closer(values, _first_spots(values, shares)))
    found = _holding(_inside(values, spots).withColumn("part", F.col("x")), "which")
    results = []
    for i, (name, (_, share)) in enumerate(wanted.items()):
        low, high = (F.max(F.when(F.col("which") == 2 * i + side, F.col("x"))) for side in (0, 1))
        at = (F.max(F.when(F.col("which") == 2 * i, F.col("all"))) - 1) * share
        results.append((low + (high - low) * (at - F.floor(at))).alias(name))
    return found.agg(*results)
