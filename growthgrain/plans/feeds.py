"""Chart feeds that need more than a table: bars in order and log-scaled axes."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def bar_feed(df: DataFrame, label: str, value: str) -> DataFrame:
    """Label and value, smallest first as bars are stacked from the axis up."""
    return df.select(label, value).orderBy(F.asc_nulls_last(value), F.asc_nulls_last(label))


def log_feed(df: DataFrame, x: str, y: str, *labels: str) -> DataFrame:
    """Labels, both measures, and the x axis on a log-10 scale (NULL for 0)."""
    return df.select(*labels, x, _log10(F.col(x)).alias(f"log10_{x}"), y)


def _log10(value: Column) -> Column:
    return F.log10(value.cast("double"))
