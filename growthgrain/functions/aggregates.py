"""Aggregate expressions."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def sum_or_zero(value: Column) -> Column:
    """Sum that ignores NULL; the sum of nothing is 0."""
    return F.coalesce(F.sum(value), F.lit(0))


def pearson(x: Column, y: Column) -> Column:
    """Pearson correlation over rows where both are present; NULL if undefined.

    ``corr`` raises under ANSI when a side has no variance, so the quotient is
    written out.
    """
    both = x.isNotNull() & y.isNotNull()
    x = F.when(both, x.cast("double"))
    y = F.when(both, y.cast("double"))
    return F.try_divide(F.covar_pop(x, y), F.sqrt(F.var_pop(x)) * F.sqrt(F.var_pop(y)))
