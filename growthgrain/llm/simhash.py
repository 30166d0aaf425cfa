"""SimHash near-duplicates with pigeonring filtering.

64-bit fingerprints in ``d + 1`` segments: if two differ in at most ``d`` bits, then some
segment is equal and, going on from it around the ring, every chain of ``n`` segments
differs in at most ``n * d / (d + 1)`` bits. The first two segments of such a chain make
the join key (the second with one bit changed at most), the budgets of the longer chains
prune candidates, and the full distance is checked last.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from growthgrain.llm.components import components
from growthgrain.session import shared_folder

BITS = 64
SEED = 42


def fingerprint(text: bytes | None, width: int) -> int:
    """Majority of the bits of the XXH64 of all runs of ``width`` lower-cased words."""
    import xxhash

    words = (text or b"").lower().split()
    if not words:
        return 0
    line = b" ".join(words)
    space = np.flatnonzero(np.frombuffer(line, np.uint8) == 0x20)
    starts, ends = [0, *(space + 1).tolist()], [*space.tolist(), len(line)]
    n, digest = max(1, len(starts) - width + 1), xxhash.xxh64_intdigest
    last = ends[width - 1 :] or ends[-1:]
    hashes = np.fromiter(
        (digest(line[a:b], SEED) for a, b in zip(starts, last, strict=False)), np.uint64, n
    )
    ones = np.zeros(BITS, np.int64)
    for a in range(0, n, 1 << 14):
        part = hashes[a : a + (1 << 14)].view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.uint16)
    return int(np.packbits(2 * ones > n, bitorder="little").view(np.int64)[0])


def fingerprints(docs: DataFrame, width: int, keep: list[str]) -> DataFrame:
    """``row`` (the columns ``keep``) and ``fp`` of every row; a text without words has
    fingerprint zero."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").cast(pa.binary())
            found = [fingerprint(t.as_py(), width) for t in texts]
            yield pa.RecordBatch.from_arrays(
                [batch.column("row"), pa.array(found, pa.int64())], names=["row", "fp"]
            )

    row = F.struct(*[docs[f"`{c}`"] for c in keep]).alias("row")
    given = docs.select(row, docs.text)
    schema = f"row {given.schema['row'].dataType.simpleString()}, fp bigint"
    return given.mapInArrow(read, schema)


def _segments(n: int) -> list[tuple[int, int]]:
    """(shift, width) of each segment."""
    at = [BITS * i // n for i in range(n + 1)]
    return [(a, b - a) for a, b in zip(at, at[1:], strict=False)]


def _part(fp: Column, segment: tuple[int, int]) -> Column:
    shift, width = segment
    return F.shiftrightunsigned(fp, shift).bitwiseAND(F.lit((1 << width) - 1))


def _keys(ring: int, key: Column, seconds: Column) -> Column:
    return F.transform(
        seconds, lambda s: F.struct(F.lit(ring).alias("ring"), (key + s).alias("key"))
    )


def _close(prints: DataFrame) -> DataFrame:
    """Links between fingerprints two bits apart at most, as stars.

    Such fingerprints are all within one bit of some value, and that value becomes the
    middle of a star; so a group of near copies gives links in proportion to its size.
    """
    one_bit = [F.lit(0), *[F.lit(1 << b if b < BITS - 1 else -(1 << b)) for b in range(BITS)]]
    near = F.transform(F.array(*[b.cast("bigint") for b in one_bit]), lambda b: b.bitwiseXOR(F.col("fp")))
    return (
        prints.select(F.col("fp").alias("a"), F.explode(near).alias("b"))
        .withColumn("n", F.count("*").over(Window.partitionBy("b")))
        .where("n > 1")
        .select("a", "b")
    )


def _ring(prints: DataFrame, distance: int) -> DataFrame:
    """Links between different groups (``root``) of fingerprints, by pigeonring chains."""
    parts = _segments(distance + 1)
    fp, asks, offers = F.col("fp"), [], []
    for i, first in enumerate(parts):
        second = parts[(i + 1) % len(parts)]
        second_part = _part(fp, second)
        key = F.shiftleft(_part(fp, first), second[1])
        # of two values one bit apart, the one without that bit asks for the other
        changed = F.array(
            second_part,
            *[
                F.when(second_part.bitwiseAND(F.lit(1 << b)) == 0, second_part + F.lit(1 << b))
                for b in range(second[1])
            ],
        )
        asks.append(_keys(i, key, F.filter(changed, lambda s: s.isNotNull())))
        offers.append(_keys(i, key, F.array(second_part)))
    asking = prints.select(
        F.col("fp").alias("a"), F.col("root").alias("root_a"), F.inline(F.concat(*asks))
    )
    offered = prints.select(
        F.col("fp").alias("b"), F.col("root").alias("root_b"), F.inline(F.concat(*offers))
    )
    apart = F.col("a").bitwiseXOR(F.col("b"))
    differ = [F.bit_count(_part(apart, p)) for p in parts]
    chains = F.lit(False)
    for i in range(len(parts)):
        run, within = F.lit(0), F.col("ring") == i
        for n in range(len(parts) - 1):
            run = run + differ[(i + n) % len(parts)]
            within = within & (run <= (n + 1) * distance // (distance + 1))
        chains = chains | within
    # a key at which one group alone is offered has nothing to tell that group; so a group
    # of any number of prints costs no more than their number at the keys it has alone
    offered = offered.repartition("ring", "key")
    only = offered.groupBy("ring", "key").agg(F.min("root_b").alias("low"), F.max("root_b").alias("high"))
    news = (F.col("low") != F.col("high")) | (F.col("low") != F.col("root_a"))
    asking = asking.join(only, ["ring", "key"]).where(news).drop("low", "high")
    candidates = asking.join(offered, ["ring", "key"]).where(F.col("root_a") != F.col("root_b"))
    return (
        candidates.where(chains)
        .where(F.bit_count(apart) <= distance)
        .select(F.col("root_a").alias("a"), F.col("root_b").alias("b"))
    )


def groups(docs: DataFrame, width: int = 4, distance: int = 4) -> DataFrame:
    """(``doc_id``, ``fp``, ``group``, ``component_id``) of every row of ``docs``.

    Fingerprints at most ``distance`` bits apart are linked, ``group`` names those that
    links connect, and ``component_id`` is the smallest ``doc_id`` among their rows.
    Equal fingerprints share one node, so copies are never paired. A text of any length is
    one fingerprint. Null ``doc_id`` rows
    join groups but never name one, unless a group has no other rows: then its
    ``component_id`` is null. Repeated rows, empty tables and further columns change
    nothing.
    """
    if not 2 <= distance <= 12:
        raise ValueError("distance must be 2 to 12 bits")
    shared_folder(docs.sparkSession)
    found = fingerprints(docs, width, ["doc_id"]).select("row.doc_id", "fp").checkpoint()
    prints = found.groupBy("fp").agg(F.min("doc_id").alias("least_id")).checkpoint()
    near = components(_close(prints))
    prints = (
        prints.join(near.withColumnRenamed("node", "fp"), "fp", "left")
        .withColumn("root", F.coalesce("root", "fp"))
        .checkpoint()
    )
    wider = components(_ring(prints, distance))
    named = prints.join(
        wider.select(F.col("node").alias("root"), F.col("root").alias("group")), "root", "left"
    ).withColumn("group", F.coalesce("group", "root"))
    least = named.groupBy("group").agg(F.min("least_id").alias("component_id"))
    return found.join(named.join(least, "group").select("fp", "group", "component_id"), "fp")


def keep_first(docs: DataFrame, width: int = 4, distance: int = 4) -> DataFrame:
    """The documents whose ``doc_id`` names their group, with their columns as they were.

    Of rows with the same ``doc_id`` one stays, and one row of each group without any id.
    """
    found = groups(docs, width, distance).checkpoint()
    names = [f"`{c}`" for c in docs.columns]
    any_first = F.min_by(F.struct(*names), F.xxhash64(*names)).alias("row")
    id_name = "kept_id"
    while id_name in docs.columns:
        id_name += "_"
    named = found.where("doc_id = component_id").groupBy(F.col("doc_id").alias(id_name))
    named = named.agg(F.count("*").alias("n")).checkpoint()
    kept = docs.join(named, docs.doc_id == named[id_name], "left_semi")
    if not named.where("n > 1").isEmpty():
        kept = kept.groupBy(docs.doc_id.alias(id_name)).agg(any_first).select("row.*")
    nameless = found.where("component_id is null").select("fp", "group").distinct()
    if not nameless.isEmpty():
        prints = fingerprints(docs.where(docs.doc_id.isNull()), width, docs.columns)
        first = F.min_by("row", F.xxhash64("row"))
        firsts = prints.join(nameless, "fp").groupBy("group").agg(first.alias("row"))
        kept = kept.unionByName(firsts.select("row.*"))
    return kept
