"""Connected components of a distributed graph."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from growthgrain.session import shared_folder


def _large_star(edges: DataFrame) -> DataFrame:
    """Hang every larger neighbour of a node onto the smallest node around it."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m"))
    return (
        both.join(least, "u")
        .where("v > u")
        .select(F.col("v").alias("u"), F.least("u", "m").alias("v"))
        .distinct()
    )


def _small_star(edges: DataFrame) -> DataFrame:
    """Hang a node and its smaller neighbours onto the smallest of them."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(least, "u").where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.withColumnRenamed("m", "v")).distinct()


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())


def components(edges: DataFrame) -> DataFrame:
    """(``node``, ``root``) for every node of the links (``a``, ``b``), root the smallest
    node reachable, by alternating stars.

    Rounds grow with the logarithm of the longest path. Each is written with
    ``checkpoint``, so a lost executor costs no more than a round. Self links and
    repeated links change nothing; a null end is an error of the caller's.
    """
    shared_folder(edges.sparkSession)
    edges = (
        edges.where("a != b")
        .select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        .distinct()
        .checkpoint()
    )
    state = _state(edges)
    while state[0]:
        edges = _small_star(_large_star(edges)).checkpoint()
        before, state = state, _state(edges)
        if state == before:
            break
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)
