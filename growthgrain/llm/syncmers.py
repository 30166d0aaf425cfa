"""Document fingerprints of closed syncmers.

A k-mer is a run of ``K`` words, or of ``K`` characters in a long run without white
space. It is chosen if the smallest hash among the runs of
``S`` words inside it is at its first or last place. The choice looks at nothing outside
the k-mer, so a passage keeps its anchors wherever it stands, at the same distances from
each other. All of it is expressions on columns.
"""

import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

K, S = 4, 2
INNER = K - S + 1
#: Words of up to 16 characters; a longer run without white space, as in scripts that do
#: not part words, counts character by character, so that no piece depends on its place.
TOKEN = r"(?<![^\x20\x09-\x0D])[^\x20\x09-\x0D]{1,16}+(?![^\x20\x09-\x0D])|[^\x20\x09-\x0D]"
#: Ranges of documents per shuffle partition.
RANGES = 8
SMALLEST = -(1 << 63)


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once."""
    return F.transform(F.array(value), body).getItem(0)


def _places(last: Column) -> Column:
    return F.when(last >= 0, F.sequence(F.lit(0), last)).otherwise(F.array().cast("array<int>"))


def _hash32(*values: Column) -> Column:
    return F.xxhash64(*values).bitwiseAND(F.lit(0xFFFFFFFF))


def anchors(text: Column) -> Column:
    """Chosen k-mers in order: structs of ``place`` (of the first word) and ``hash`` (32 bits).

    A text with words but no chosen k-mer has one anchor, of all its words, at place 0.
    A text without words, also a null one, has none.
    """

    def chosen(words: Column, pairs: Column) -> Column:
        inner = [lambda i, n=n: F.get(pairs, i + n) for n in range(INNER)]

        def closed(i: Column) -> Column:
            least = F.least(*[at(i) for at in inner])
            return (least == inner[0](i)) | (least == inner[-1](i))

        def anchor(i: Column) -> Column:
            parts = [F.get(pairs, i + n) for n in range(0, K - S + 1, S)]
            rest = [F.get(words, i + n) for n in range(len(parts) * S, K)]
            return F.struct(i.alias("place"), _hash32(*parts, *rest).alias("hash"))

        return F.transform(F.filter(_places(F.size(words) - K), closed), anchor)

    def whole(words: Column) -> Column:
        return F.aggregate(words, F.lit(0).cast("bigint"), lambda all_, w: _hash32(all_, w))

    def of_words(words: Column) -> Column:
        pairs = F.transform(
            _places(F.size(words) - S), lambda i: F.xxhash64(*[F.get(words, i + n) for n in range(S)])
        )
        return _let(
            _let(pairs, lambda found: chosen(words, found)),
            lambda found: F.when((F.size(found) > 0) | (F.size(words) == 0), found).otherwise(
                F.array(F.struct(F.lit(0).alias("place"), whole(words).alias("hash")))
            ),
        )

    tokens = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(TOKEN), F.lit(0))
    return _let(F.transform(tokens, lambda t: F.xxhash64(t)), of_words)


def hashes(found: Column) -> Column:
    return F.transform(found, lambda a: a["hash"])


def fingerprint(prints: Column) -> Column:
    """Hashes as text, eight hexadecimal digits each."""
    return F.array_join(F.transform(prints, lambda h: F.lower(F.lpad(F.hex(h), 8, "0"))), "")


def likeness(a: Column, b: Column) -> Column:
    """Shared hashes among all hashes of two texts; two texts without any are alike."""
    either = F.size(F.array_union(a, b))
    shared = F.size(F.array_intersect(a, b))
    return F.when(either == 0, F.lit(1.0)).otherwise(shared / either)


def aligned(a: Column, b: Column, shift: Column) -> Column:
    """Anchors of ``a`` that ``b`` has ``shift`` words further on."""
    moved = F.transform(
        a, lambda x: F.struct((x["place"] + shift).alias("place"), x["hash"].alias("hash"))
    )
    return F.size(F.array_intersect(moved, b))


def _literal(values: list, kind: str) -> Column:
    """A constant array; as one JSON text it costs the plan one node however long it is."""
    return F.from_json(F.lit(json.dumps(values)), f"array<{kind}>")


def _ranges(docs: DataFrame, n: int) -> tuple[Column, list[int | None]]:
    """A number from 0 to n - 1 that rises with ``order_id`` in steps of about equally
    many documents, and the largest ``order_id`` of each step."""
    cut = F.percentile_approx("order_id", [i / n for i in range(1, n)], 20 * n)
    bounds = sorted(set(docs.agg(cut).first()[0] or []))
    steps = [1 << i for i in reversed(range(len(bounds).bit_length()))]
    held = _literal(bounds, "bigint")
    range_of = F.aggregate(
        _literal(steps, "int"),
        F.lit(0),
        lambda at, step: F.when(F.get(held, at + step - 1) <= F.col("order_id"), at + step).otherwise(at),
    )
    found = docs.groupBy(range_of.alias("range")).agg(F.max("order_id").alias("top")).collect()
    tops = dict.fromkeys(range(len(bounds) + 1)) | {row["range"]: row["top"] for row in found}
    return range_of, [tops[i] for i in range(len(bounds) + 1)]


def with_next(docs: DataFrame) -> DataFrame:
    """``range``, ``order_id``, ``extra``, ``doc_id`` and ``text``: every document in its range of
    ids and, as ``extra`` rows, the first document after each range, so that a range holds
    what its own documents need. Texts pass one shuffle; the driver holds two numbers for
    each range.
    """
    n = RANGES * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order_id = F.coalesce(docs.doc_id.cast("bigint"), F.lit(SMALLEST))
    docs = docs.select(docs.doc_id, docs.text, order_id.alias("order_id"))
    range_of, tops = _ranges(docs.select("order_id"), n)
    there = [i for i, top in enumerate(tops) if top is not None]
    # the range that a range's largest document follows; the very largest follows the smallest
    above = dict(zip(there, [*there[1:], *there[:1]], strict=True))
    top_of = _literal(tops, "bigint")
    above_of = _literal([above.get(i) for i in range(len(tops))], "int")
    docs = docs.withColumn("own", range_of)
    copies = F.array(
        F.struct(F.col("own").alias("range"), F.lit(False).alias("extra")),
        F.when(
            F.get(top_of, F.col("own")) == F.col("order_id"),
            F.struct(F.get(above_of, F.col("own")).alias("range"), F.lit(True).alias("extra")),
        ),
    )
    return docs.select(
        "order_id", "doc_id", "text", F.inline(F.filter(copies, lambda c: c.isNotNull()))
    )


def edited_pairs(docs: DataFrame) -> DataFrame:
    """Fingerprints of every document and of its edited text, and how alike they are.

    The edited text ends in the beginning of the next document by falling ``doc_id``,
    in place of its own second half; the smallest is followed by the largest. A null
    ``doc_id`` comes after all others, equal ids are ordered by text. Null texts are
    empty. Repeated rows give a row each, an empty table gives none, and further columns
    are not read.
    """
    in_order = Window.partitionBy("range").orderBy(
        "extra", F.desc("order_id"), F.xxhash64("text"), F.col("text")
    )
    half = F.floor(F.col("n_chars") / 2).cast("int")
    return (
        with_next(docs)
        .withColumn("text", F.coalesce("text", F.lit("")))
        .withColumn("next_text", F.lead("text").over(in_order))
        .withColumn("n_chars", F.length("text").cast("bigint"))
        .withColumn(
            "edited",
            F.concat(
                F.substring(F.col("text"), F.lit(1), (F.col("n_chars") - half).cast("int")),
                F.substring(F.coalesce("next_text", F.lit("")), F.lit(1), half),
            ),
        )
        .select(
            "range",
            "extra",
            "order_id",
            "doc_id",
            "text",
            "n_chars",
            F.sha2("edited", 256).alias("edited_sha256"),
            hashes(anchors(F.col("text"))).alias("own"),
            hashes(anchors(F.col("edited"))).alias("changed"),
        )
        .withColumn("following", F.lead("own").over(in_order))
        .where(~F.col("extra"))
        .select(
            "doc_id",
            "n_chars",
            "edited_sha256",
            fingerprint(F.col("own")).alias("fingerprint"),
            fingerprint(F.col("changed")).alias("edited_fingerprint"),
            likeness(F.col("own"), F.col("changed")).alias("near_edited"),
            likeness(F.col("own"), F.col("following")).alias("near_next"),
        )
    )
