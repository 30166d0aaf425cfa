"""Least squares."""

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# A feature is left out if so small a share of its square is not explained by those before it.
TOLERANCE = 1e-14


def _solved(matrix: Column, size: Column, n: int) -> Column:
    """Weights of ``n`` features from their covariances, the last column those with the label.

    Gauss-Jordan elimination in the order of the features. One that those before it
    explain has no weight, as if it had not been given.
    """

    def eliminate(rows: Column, k: Column) -> Column:
        pivot_row = F.get(rows, k)
        pivot = F.get(pivot_row, k)
        left_out = pivot <= F.lit(TOLERANCE) * F.get(size, k)

        def row_after(row: Column, i: Column) -> Column:
            factor = F.get(row, k) / pivot
            return (
                F.when(left_out & (i == k), F.transform(row, lambda x: F.lit(0.0)))
                .when(left_out, F.transform(row, lambda x, j: F.when(j == k, 0.0).otherwise(x)))
                .when(i == k, F.transform(row, lambda x: x / pivot))
                .otherwise(F.transform(row, lambda x, j: x - factor * F.get(pivot_row, j)))
            )

        return F.transform(rows, row_after)

    rows = F.aggregate(F.sequence(F.lit(0), F.lit(n - 1)), matrix, eliminate)
    return F.transform(rows, lambda row: F.get(row, F.lit(n)))


def ols_fit_predict(df: DataFrame, label: str, features: list[str], output: str) -> DataFrame:
    """Fit ``label ~ features`` with an intercept and score the same rows.

    Rows with a missing value are left out of the fit; rows with a missing feature
    get no prediction. Means and covariances are one aggregate that combines on the map
    side, solved as an expression in a scalar subquery: nothing runs until the result is
    asked for, and the subquery reads the shuffle the rows come from. Features that those
    before them explain, constants among them, are left out; without any row to fit, all
    predictions are missing.
    """
    has_features = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in features])
    complete = has_features & F.col(label).isNotNull()
    x = [F.when(complete, F.col(c).cast("double")) for c in features]
    y = F.when(complete, F.col(label).cast("double"))
    means = df.agg(
        F.array(*[F.avg(v) for v in x]).alias("means"),
        F.avg(y).alias("label"),
        F.array(*[F.array(*[F.covar_pop(a, b) for b in [*x, y]]) for a in x]).alias("matrix"),
    )
    # the square of a feature about 0, against which what is left of it is small
    size = F.transform("matrix", lambda row, i: F.get(row, i) + F.get("means", i) * F.get("means", i))
    weights = _solved(F.col("matrix"), size, len(features))
    fit = means.select(F.struct("means", "label", weights.alias("weights"))).scalar()
    fitted = fit["label"]
    for i, column in enumerate(features):
        fitted = fitted + fit["weights"][i] * (F.col(column) - fit["means"][i])
    return df.withColumn(output, F.when(has_features, fitted))
