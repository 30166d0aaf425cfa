"""Statistics over derived tables."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from growthgrain.functions.aggregates import sum_or_zero

# Values enter the deviation in billionths; they are split at one, so that sums of
# products keep to 38 digits.
UNIT = 1_000_000_000


def scalars(one_row: DataFrame) -> dict[str, Column]:
    """Each column of a one-row table as a part of one scalar subquery."""
    row = one_row.select(F.struct(*one_row.columns)).scalar()
    return {name: row[name] for name in one_row.columns}


def _split(units: Column) -> tuple[Column, Column]:
    """Whole values and billionths of a number of billionths, the second not negative."""
    rest = F.pmod(units, F.lit(UNIT))
    return F.round((units - rest) / F.lit(UNIT)).cast("decimal(29,0)"), rest.cast("decimal(10,0)")


def _whole(number: Column) -> Column:
    """Nearest whole number to a double, as a decimal; from 2**53 on each is whole itself."""
    near = F.floor(number + 0.5)
    return F.when(F.abs(number) < 9e18, near).otherwise(number.cast("decimal(38,0)"))


def weighted_sd(
    df: DataFrame, keys: list[str], value: str, weight: str, name: str, **more: Column
) -> DataFrame:
    """Weighted population standard deviation of ``value`` per ``keys``, in billionths.

    ``more`` are further aggregates to take in the same grouping. Weights are whole
    numbers. 0 where the weights add up to 0. Rows without a value drop out of both means;
    a row with a value but no weight makes the result NULL.

    Values are rounded to billionths. Weights, weighted values and weighted squares are
    added up as whole numbers, so exactly and in any order; they combine on the map side,
    and a group is six numbers. The mean is taken off the sums afterwards, exactly too, so
    nothing cancels. Squares of whole values, times their weights, may add up to 1e37; more
    fail the query.
    """
    present = F.col(value).isNotNull()
    w = F.when(present, F.col(weight)).cast("decimal(19,0)")
    a, b = _split(_whole(F.col(value).cast("double") * float(UNIT)))
    moments = {"w": w, "a": w * a, "b": w * b, "aa": w * a * a, "ab": w * a * b, "bb": w * b * b}
    sums = [F.sum(m.cast("decimal(38,0)")).alias(f"_{n}") for n, m in moments.items()]
    summed = df.groupBy(*keys).agg(
        *sums,
        sum_or_zero(F.col(weight)).alias("_weight"),
        F.count_if(present & F.col(weight).isNull()).alias("_unweighted"),
        *[column.alias(c) for c, column in more.items()],
    )
    w, a, b, aa, ab, bb = (F.col(f"_{n}") for n in moments)
    total = F.col("_total")
    mean = F.when(w != 0, F.round((total - total % w) / w).cast("decimal(38,0)"))
    mean_a, mean_b = _split(F.col("_mean"))
    large = aa - 2 * mean_a * a + mean_a * mean_a * w
    mixed = ab - mean_a * b - mean_b * a + mean_a * mean_b * w
    small = bb - 2 * mean_b * b + mean_b * mean_b * w
    unit = F.lit(UNIT).cast("decimal(10,0)")
    # the square in three digits to the base of a billion, the first of any size
    carried, last = _split(F.col("_small"))
    whole, middle = _split(2 * F.col("_mixed") + carried)
    first, rest = F.col("_first"), F.col("_middle") * unit + F.col("_last")
    square = F.when(first < F.lit(10).cast("decimal(38,0)") * unit * unit, (first * unit * unit + rest).cast("double"))
    square = square.otherwise(first.cast("double") * float(UNIT) ** 2 + rest.cast("double"))
    off, weights = (total - F.col("_mean") * w).cast("double"), w.cast("double")
    deviation = F.sqrt(F.greatest(square - off * off / weights, F.lit(0.0)) / weights)
    return (
        summed.withColumn("_total", (a * unit + b).cast("decimal(38,0)"))
        .withColumn("_mean", mean)
        .withColumns({"_large": large, "_mixed": mixed, "_small": small})
        .withColumns({"_first": F.col("_large") + whole, "_middle": middle, "_last": last})
        .select(
            *keys,
            F.when(F.col("_weight") == 0, F.lit(0.0))
            .when((F.col("_unweighted") > 0) | (w == 0), F.lit(None))
            .otherwise(_whole(deviation).cast("double") / float(UNIT))
            .alias(name),
            *more,
        )
    )
