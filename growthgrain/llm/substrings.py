"""Repeated word sequences across documents.

Every window of ``width`` words of every document gets a Rabin-Karp hash. Buckets of
hashes find the smallest document each window starts in; windows that also start in a
smaller document are marked where they stand, and marked windows that touch or overlap
merge into maximal intervals, whose words are removed.
"""

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from growthgrain.llm import chunks
from growthgrain.llm.words import (
    Words,
    covered,
    pack,
    pack_sorted,
    read_words,
    unpack,
    unpack_sorted,
    window_hashes,
    word_hashes,
)

WIDTH = 50
ASKED = "bucket int, chunk int, keys binary, owners binary, ids binary"
TOLD = "chunk int, bucket int, places binary"


class Windows:
    """The windows of a chunk: ``keys`` are their sorted distinct hashes, ``least`` the
    smallest document number for each, ``at`` the first word of every window, and ``key``
    the place of its hash in ``keys``."""

    def __init__(self, texts: list[bytes | None], ids: np.ndarray, width: int):
        self.words: Words = read_words(texts)
        hashes = window_hashes(word_hashes(self.words), width)
        owner = self.words.text_of()
        ends = self.words.first[1:][owner[: len(hashes)]]
        self.at = np.flatnonzero(np.arange(len(hashes)) + width <= ends)
        self.ids = ids[owner[self.at]]
        hashes = hashes[self.at]
        order = np.argsort(hashes, kind="stable")
        new = np.diff(hashes[order], prepend=np.uint64(0)) != 0
        new[:1] = True
        self.keys = hashes[order[new]]
        self.key = np.empty(len(hashes), np.int64)
        self.key[order] = np.cumsum(new) - 1
        begins = np.flatnonzero(new)
        self.least = (
            np.minimum.reduceat(self.ids[order], begins) if len(begins) else np.zeros(0, np.int64)
        )


def _ask(width: int, n_buckets: int) -> Callable[[pa.Table], pa.Table]:
    def ask(table: pa.Table) -> pa.Table:
        found = Windows(chunks.texts_of(table), chunks.ids_of(table), width)
        cuts = chunks.bucket_cuts(found.keys, n_buckets)
        rows: dict[str, list] = {name: [] for name in ("bucket", "chunk", "keys", "owners", "ids")}
        for b in np.flatnonzero(np.diff(cuts)):
            part = slice(cuts[b], cuts[b + 1])
            ids, owners = np.unique(found.least[part], return_inverse=True)
            rows["bucket"].append(int(b))
            rows["chunk"].append(table.column("chunk")[0].as_py())
            rows["keys"].append(pack_sorted(found.keys[part]))
            rows["owners"].append(pack(owners.astype(np.uint32)))
            rows["ids"].append(pack_sorted(ids))
        return chunks.as_table(rows, ASKED)

    return ask


def _answer(table: pa.Table) -> pa.Table:
    """For each chunk, the places of those keys that have a smaller document elsewhere."""
    keys = [unpack_sorted(k.as_py()) for k in table.column("keys")]
    ids = [
        unpack_sorted(i.as_py())[unpack(o.as_py())]
        for i, o in zip(table.column("ids"), table.column("owners"), strict=True)
    ]
    until = np.cumsum([0, *map(len, keys)])
    keys, ids = np.concatenate(keys), np.concatenate(ids)
    order = np.argsort(keys, kind="stable")
    new = np.diff(keys[order], prepend=np.uint64(0)) != 0
    new[0] = True
    least = np.minimum.reduceat(ids[order], np.flatnonzero(new))
    smaller = np.empty(len(keys), bool)
    smaller[order] = ids[order] > least[np.cumsum(new) - 1]
    rows: dict[str, list] = {"chunk": [], "bucket": [], "places": []}
    for i, (a, b) in enumerate(zip(until, until[1:], strict=False)):
        places = np.flatnonzero(smaller[a:b])
        if len(places):
            rows["chunk"].append(table.column("chunk")[i].as_py())
            rows["bucket"].append(table.column("bucket")[i].as_py())
            rows["places"].append(pack_sorted(places))
    return chunks.as_table(rows, TOLD)


def _finish(width: int, n_buckets: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    def finish(table: pa.Table, told: pa.Table) -> pa.Table:
        texts = chunks.texts_of(table)
        found = Windows(texts, chunks.ids_of(table), width)
        cuts = chunks.bucket_cuts(found.keys, n_buckets)
        elsewhere = np.zeros(len(found.keys), bool)
        for bucket, places in zip(told.column("bucket"), told.column("places"), strict=True):
            elsewhere[cuts[bucket.as_py()] + unpack_sorted(places.as_py())] = True
        marked = elsewhere[found.key] | (found.ids > found.least[found.key])
        marks = np.zeros(len(found.words.starts), bool)
        marks[found.at[marked]] = True
        gone = covered(marks, width)
        first = found.words.first
        removed = np.diff(np.concatenate([[0], np.cumsum(gone)])[first])
        kept = []
        for i, text in enumerate(texts):
            words = (text or b"").split()
            if removed[i]:
                words = [words[w] for w in np.flatnonzero(~gone[first[i] : first[i + 1]])]
            kept.append(b" ".join(words))
        made = {
            "row": table.column("row"),
            "text": table.column("text"),
            "n_words": pa.array(found.words.counts(), pa.int64()),
            "n_removed": pa.array(removed, pa.int64()),
            "kept": pa.array(kept, pa.binary()).cast(pa.string()),
        }
        return pa.table(made)

    return finish


def repeats(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """``row`` (the columns of ``docs`` but the text), ``text``, ``n_words``, ``n_removed``
    and ``kept``, the words that stay, joined by one space.

    A word goes if a window over it also starts in a document with a smaller ``doc_id``,
    so the first document keeps its words. Null texts have no words. A null ``doc_id``
    is larger than all others; rows with equal ids are not smaller than each other and
    take nothing from each other. An empty table gives no rows.
    """
    n = chunks.chunk_count(docs)
    texts = chunks.chunked(docs, n)
    asked = texts.groupBy("chunk").applyInArrow(_ask(width, n), ASKED)
    told = asked.groupBy("bucket").applyInArrow(_answer, TOLD)
    row = texts.schema["row"].dataType.simpleString()
    schema = f"row {row}, text string, n_words bigint, n_removed bigint, kept string"
    return chunks.by_chunk(texts, told, _finish(width, n), schema)


def without_repeats(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """The documents with repeated words removed; ``n_chars`` follows where there is one.

    A text that loses nothing stays as it was, white space included. A document that
    loses every word goes.
    """
    found = repeats(docs, width).where("n_removed = 0 or n_removed < n_words")
    text = F.when(F.col("n_removed") > 0, F.col("kept")).otherwise(F.col("text"))
    columns = {c: F.col("row")[c] for c in docs.columns} | {"text": text}
    if "n_chars" in docs.columns:
        length = F.when(F.col("n_removed") > 0, F.length("kept")).otherwise(columns["n_chars"])
        columns["n_chars"] = length.cast(docs.schema["n_chars"].dataType)
    return found.select(*[column.alias(c) for c, column in columns.items()])


SQL = """
WITH d AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS words FROM documents
), windows AS (
  SELECT doc_id, i, md5(array_to_string(words[i:i + 49], ' ')) AS words
  FROM d, unnest(range(1, len(words) - 48)) AS t(i)
), least AS (
  SELECT words, min(doc_id) AS first_doc FROM windows GROUP BY words
), gone AS (
  SELECT DISTINCT doc_id, j FROM windows JOIN least USING (words), unnest(range(i, i + 50)) AS t(j)
  WHERE first_doc < doc_id
), all_words AS (
  SELECT doc_id, j, words[j] AS word FROM d, unnest(range(1, len(words) + 1)) AS t(j)
), kept AS (
  SELECT doc_id, count(*) AS n_kept, string_agg(word, ' ' ORDER BY j) AS text
  FROM all_words ANTI JOIN gone USING (doc_id, j) GROUP BY doc_id
)
SELECT doc_id, len(words) AS n_words, len(words) - coalesce(n_kept, 0) AS n_removed,
  sha256(coalesce(text, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)
"""
