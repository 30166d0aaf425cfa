"""Deduplication."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def first_row_by(columns: list[str]) -> Column:
    """Aggregate giving the first whole row of a group, sorted by ``columns``.

    NULL sorts last and strings sort bytewise. ``columns`` must name everything
    that is to be kept, so that the order is total. As a plain ``min`` it combines
    on the map side: a key with any number of copies leaves each task as one row.
    """
    parts = []
    for name in columns:
        parts += [F.col(name).isNull().alias(f"{name}_missing"), F.col(name)]
    return F.min(F.struct(*parts))
