"""Joins of facts with a table of one row per key, whatever share of the facts a key has."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from growthgrain.operators.keys import KEY

# The key that a fact is sent to a task by: its own, or for a hot one a piece of it.
SPREAD = "spread_key"
# A key is hot if it has more than one in so many of the facts, and so many at least.
SHARE, LEAST = 2000, 10_000
# Keys the sketch follows at once; it misses none with more than one in SHARE.
FOLLOWED = 16_000
PIECES = 1 << 16


def hot_keys(facts: DataFrame, key: str = KEY, least: int = LEAST) -> DataFrame:
    """``hot_key``: the frequent keys of ``facts``, at most ``SHARE`` of them.

    A sketch that combines on the map side, so a reading of the one column. Which keys it
    names decides how facts travel and nothing else.
    """
    top = F.expr(f"approx_top_k(`{key}`, {SHARE}, {FOLLOWED})").alias("top")
    found = facts.agg(top, F.count("*").alias("n")).select("n", F.inline("top"))
    often = F.col("count") > F.greatest(F.col("n") / SHARE, F.lit(least))
    return found.where(often).select(F.col("item").alias("hot_key"))


def _piece(facts: DataFrame) -> Column:
    """One of many keys that no profile has, even over the rows of any one key."""
    row = F.pmod(F.xxhash64(*facts.columns, F.spark_partition_id()), F.lit(PIECES))
    return F.concat(F.lit("#"), row.cast("string"))


def join_spread(
    facts: DataFrame, lookup: DataFrame, columns: list[str], key: str = KEY, least: int = LEAST
) -> DataFrame:
    """``facts`` with ``columns`` of the row of ``lookup`` that has their key, NULL without
    one, and ``spread_key``.

    Facts pass one exchange. The rows of ``lookup`` for hot keys, ``SHARE`` at most, are
    sent to all tasks; facts of these keys take their columns from there and travel in
    even pieces, under keys that end in no ``=`` and so meet no row. All others meet their
    row under their own key. So no task gets a hot key whole, whatever AQE is set to, and
    the result is grouped by ``spread_key`` without a further exchange.
    """
    hot = hot_keys(facts, key, least)
    named = {c: f"_hot_{c}" for c in columns}
    rows = lookup.join(F.broadcast(hot), F.col(key) == F.col("hot_key"))
    rows = rows.select(F.col(key).alias("_found"), *[F.col(c).alias(n) for c, n in named.items()])
    rows = hot.join(F.broadcast(rows), F.col("hot_key") == F.col("_found"), "left").drop("_found")
    marked = facts.join(F.broadcast(rows), F.col(key) == F.col("hot_key"), "left")
    is_hot = F.col("hot_key").isNotNull()
    spread = F.when(is_hot, _piece(facts)).otherwise(F.col(key))
    others = lookup.select(F.col(key).alias("_key"), *[F.col(c).alias(f"_own_{c}") for c in columns])
    joined = marked.withColumn(SPREAD, spread).join(others, F.col(SPREAD) == F.col("_key"), "left")
    taken = [F.when(is_hot, F.col(n)).otherwise(F.col(f"_own_{c}")).alias(c) for c, n in named.items()]
    return joined.select(*[F.col(c) for c in facts.columns], *taken, SPREAD)


def n_keys(key: str = KEY) -> Column:
    """Different keys among rows that are one per ``spread_key`` and ``key``: the hot ones,
    ``SHARE`` at most, as a set, the others one by one."""
    own = F.col(key) == F.col(SPREAD)
    return F.count_if(own) + F.size(F.collect_set(F.when(~own, F.col(key))))
