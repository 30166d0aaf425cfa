"""Packing by power-of-two lengths.

The tokens of a document are cut into pieces of the maximum length and then, for the
rest, into one piece for each bit of its length, longest first. A piece is a sequence of
its own, so no sequence crosses documents and none needs padding; sequences of equal
length form a bucket, from which batches are drawn.
"""

import base64
import zlib
from collections.abc import Callable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MAX_LENGTH = 1024
END = 0
#: A text with a block of so much white space is left to ``tokenizers``; tiktoken's
#: matcher fails on runs of some hundred thousand characters.
BLANK = 5000


def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def encoder(path: str):
    """The byte-level BPE whose ranks are in ``path``; special strings are ordinary text."""
    import public_tokenizers
    import tiktoken

    with open(path, "rb") as file:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
    return tiktoken.Encoding(
        "byte_bpe", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}
    )


def _blank(text: str) -> bool:
    """Whether one of the blocks of ``BLANK`` characters is white space; a run twice as
    long holds a block wherever it begins."""
    return any(not text[a : a + BLANK].strip() for a in range(0, len(text) - BLANK + 1, BLANK))


def ids_encoder(path: str, tokenizer: str) -> Callable[[str], list[int]]:
    """The ids that the tokenizer in the file ``tokenizer`` gives, no special tokens added.

    Its added tokens are found in texts. Texts without them, and without very long runs
    of white space, go through the same vocabulary as ranks in ``path``, which is faster.
    """
    from tokenizers import Tokenizer

    whole, ordinary = Tokenizer.from_file(tokenizer), encoder(path).encode_ordinary
    added = [token.content for token in whole.get_added_tokens_decoder().values()]

    def encode(text: str) -> list[int]:
        if any(token in text for token in added) or _blank(text):
            return whole.encode(text, add_special_tokens=False).ids
        return ordinary(text)

    return encode


def cuts(n: int, longest: int = MAX_LENGTH) -> list[int]:
    """Lengths, longest first, that add up to ``n``: powers of two up to ``longest``."""
    rest = n % longest
    bits = [1 << b for b in reversed(range(longest.bit_length())) if rest >> b & 1]
    return [longest] * (n // longest) + bits


def _cut(
    batches: Iterator[pa.RecordBatch], path: str, tokenizer: str, longest: int, with_ids: bool
) -> Iterator[pa.RecordBatch]:
    encode = ids_encoder(path, tokenizer)
    for batch in batches:
        docs, texts = batch.column("doc_id"), batch.column("text")
        for a in range(0, len(texts), 256):
            owner, start, length, total, crc, ids = [], [], [], [], [], []
            for i, text in enumerate(texts[a : a + 256]):
                tokens = np.array([*encode(text.as_py() or ""), END], "<u4")
                at = 0
                for n in cuts(len(tokens), longest):
                    piece = tokens[at : at + n]
                    owner.append(a + i)
                    start.append(at)
                    length.append(n)
                    total.append(len(tokens))
                    crc.append(zlib.crc32(piece))
                    if with_ids:
                        ids.append(piece.astype(np.int32))
                    at += n
            numbers = [pa.array(x, pa.int64()) for x in (start, length, crc, total)]
            made = [docs.take(pa.array(owner, pa.int64())), *numbers]
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
            if with_ids:
                made.append(pa.array(ids, pa.list_(pa.int32())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(made, names=names)


def pack_documents(
    docs: DataFrame,
    path: str | None = None,
    longest: int = MAX_LENGTH,
    with_ids: bool = True,
    tokenizer: str | None = None,
) -> DataFrame:
    """One row per piece: its document, place and tokens, and its sequence.

    ``tokenizer`` is a file of ``tokenizers`` and ``path`` the ranks of its vocabulary.
    A null or empty text is a document of the end token alone. A null ``doc_id`` stays
    null, repeated rows are packed each for itself, an empty table gives no rows, and
    further columns of ``docs`` are not read. A sequence holds one piece, so ``offset``
    is 0 and ``sequence_id`` the number of the piece; nothing is shuffled.
    """
    schema = (
        f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, start bigint, length bigint, "
        "ids_crc32 bigint, doc_tokens bigint" + ", ids array<int>" * with_ids
    )
    files = {"path": path or vocabulary_path(), "tokenizer": tokenizer or tokenizer_path()}
    cut = partial(_cut, **files, longest=longest, with_ids=with_ids)
    return (
        docs.select(docs.doc_id, docs.text)
        .mapInArrow(cut, schema)
        .withColumn("sequence_id", F.monotonically_increasing_id())
        .withColumn("offset", F.lit(0).cast("bigint"))
    )
