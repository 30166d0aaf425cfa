"""Chunks of documents that ask questions about the whole corpus.

Work on the tokens of a large corpus is done in two places. A *chunk* is some megabytes
of documents, picked by a hash of the document so that reruns make the same chunks. A
*bucket* is a range of hash values. Chunks send each bucket the sorted, compressed hashes
they hold in its range, as one row; buckets count over all chunks and answer in the same
way; an answer meets the texts of its chunk again. So each token passes the shuffle as a
few compressed bytes, frequent tokens once per chunk, and a task holds one chunk or one
bucket at a time.
"""

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CHUNK_BYTES = 8_000_000
SMALL_CHUNK_BYTES = 1_000_000
LAST_ID = np.iinfo(np.int64).max


def text_bytes(docs: DataFrame) -> int:
    return docs.agg(F.sum(F.octet_length(docs.text))).first()[0] or 0


def chunk_count(docs: DataFrame, chunk_bytes: int = CHUNK_BYTES) -> int:
    """Enough chunks for their size; on small inputs one for every task, if not too small."""
    tasks, size = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), text_bytes(docs)
    return max(1, -(-size // chunk_bytes), min(tasks, size // SMALL_CHUNK_BYTES))


def chunked(docs: DataFrame, n: int, **more: Column) -> DataFrame:
    """``chunk``, ``doc_id``, ``text``, ``more`` and, in ``row``, the columns but the text."""
    others = [docs[f"`{c}`"] for c in docs.columns if c != "text"]
    chunk = F.pmod(F.xxhash64(docs.doc_id, docs.text), F.lit(n)).cast("int")
    return docs.select(
        chunk.alias("chunk"),
        F.struct(*others).alias("row"),
        docs.doc_id,
        docs.text,
        *[column.alias(name) for name, column in more.items()],
    )


def texts_of(table: pa.Table) -> list[bytes | None]:
    return table.column("text").cast(pa.binary()).to_pylist()


def ids_of(table: pa.Table) -> np.ndarray:
    """Document numbers; a missing one comes after all others."""
    ids = table.column("doc_id").cast(pa.int64())
    return ids.fill_null(LAST_ID).to_numpy()


def bucket_cuts(keys: np.ndarray, n: int) -> np.ndarray:
    """Where each of ``n`` equal ranges of 64 bits begins in sorted keys, and the end."""
    bounds = [(b << 64) // n for b in range(n)]
    return np.append(np.searchsorted(keys, np.array(bounds, np.uint64)), len(keys))


def by_chunk(
    chunks: DataFrame, answers: DataFrame, work: Callable[..., pa.Table], schema: str
) -> DataFrame:
    """``work(texts, answers)`` for every chunk; a chunk without answers gets an empty table."""
    pairs = chunks.groupBy("chunk").cogroup(answers.groupBy("chunk"))
    return pairs.applyInArrow(work, schema)


def as_table(columns: dict[str, list], schema: str) -> pa.Table:
    """Columns of plain values as an Arrow table of a schema like ``a int, b binary``."""
    kinds = {"int": pa.int32(), "bigint": pa.int64(), "binary": pa.binary(), "double": pa.float64()}
    fields = [field.split() for field in schema.split(", ")]
    return pa.table({name: pa.array(columns[name], kinds[kind]) for name, kind in fields})
