"""Keys under which NULL matches NULL, and checks on key uniqueness."""

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KEY = "pk"


def with_key(df: DataFrame) -> DataFrame:
    """Add ``pk``: the profile id as a string that is never NULL.

    A missing id becomes the empty string and ``x`` becomes ``x=``, so plain
    equality on ``pk`` has the NULL-matches-NULL meaning. Being one plain string
    that starts like the id, it sorts by prefix, can be bucketed, and the
    partitioning of a ``groupBy`` on it is kept by a following join or ``distinct``.
    """
    return df.withColumn(KEY, F.coalesce(F.concat(F.col("profile_id"), F.lit("=")), F.lit("")))


def profile_id_of(key: Column) -> Column:
    """The profile id a ``pk`` was made from."""
    return F.when(key != "", F.left(key, F.length(key) - 1))


def null_safe_left(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Left join on ``keys`` where NULL matches NULL; the right keys are dropped.

    No side is hinted as broadcast: the planner and AQE choose by measured size.
    """
    renamed = right.select(
        *[F.col(c).alias(f"_right_{c}") if c in keys else F.col(c) for c in right.columns]
    )
    condition = reduce(
        lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_right_{k}")) for k in keys]
    )
    return left.join(renamed, condition, "left").drop(*[f"_right_{k}" for k in keys])


def key_violations(df: DataFrame, keys: list[str]) -> DataFrame:
    """Key values held by more than one row, with the number of rows."""
    return df.groupBy(*keys).agg(F.count("*").alias("n_rows")).where(F.col("n_rows") > 1)


def one_row_per(df: DataFrame, keys: list[str]) -> DataFrame:
    """``df``, failing when it runs if two rows share ``keys``.

    The check is a grouping on the keys, so it moves no rows of a table that is
    partitioned or bucketed by one of them.
    """
    others = [c for c in df.columns if c not in keys]
    message = F.concat(F.lit("more than one row for "), F.to_json(F.struct(*keys)))
    one = F.when(F.col("_rows") == 1, F.col("_row")).otherwise(F.raise_error(message))
    return (
        df.groupBy(*keys)
        .agg(F.any_value(F.struct(*others)).alias("_row"), F.count("*").alias("_rows"))
        .withColumn("_row", one)
        .select(*[F.col(c) if c in keys else F.col("_row")[c].alias(c) for c in df.columns])
    )


def assert_unique(df: DataFrame, keys: list[str]) -> DataFrame:
    """Return ``df`` if no two rows share ``keys``, else raise. Runs a job."""
    offending = key_violations(df, keys).take(1)
    if offending:
        raise ValueError(f"more than one row for {offending[0].asDict()}")
    return df
