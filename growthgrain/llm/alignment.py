"""Alignment of the tokens of two tokenizers.

Both cut the same bytes, so wherever a token of each ends at the same byte a group ends.
A group of one token each holds the same bytes twice: an array from the ids of the first
vocabulary to those of the second names such pairs by one id, and they are counted in
vectors as long as the vocabulary. Only the other pairs are rows that meet in a shuffle,
once for each chunk of documents that holds them.
"""

import hashlib
import json
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from growthgrain.llm import packing
from growthgrain.llm.words import pack, unpack
from growthgrain.session import shared_folder

#: Bytes of text whose pairs are held together.
CHUNK_BYTES = 4_000_000
DIGEST = "n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups_sha256 string"
COUNTED = ["n_a", "n_b", "n_groups", "n_links"]


def pieces_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class Files(NamedTuple):
    """``tokenizer`` and ``ranks``: the byte-level vocabulary as a file of ``tokenizers``
    and as ranks; ``pieces``: the model of the other."""

    tokenizer: str
    ranks: str
    pieces: str


def public_files() -> Files:
    return Files(packing.tokenizer_path(), packing.vocabulary_path(), pieces_path())


def byte_of_symbol() -> dict[str, int]:
    """The byte each symbol of a byte-level vocabulary stands for: printable Latin-1 stands
    for itself, the other bytes in turn for the characters from 256 on."""
    plain = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Aligned(NamedTuple):
    """A text by both vocabularies: ids, where groups end (as numbers of tokens), and for
    each link the ids it joins."""

    a: np.ndarray
    b: np.ndarray
    a_ends: np.ndarray
    b_ends: np.ndarray
    link_a: np.ndarray
    link_b: np.ndarray

    def groups(self, texts_a: np.ndarray, texts_b: np.ndarray) -> str:
        """``a1,a2|b1;a3|b2,b3``: the ids of the groups in order."""
        n_a, n_b = len(self.a), len(self.b)
        group_a = np.searchsorted(self.a_ends, np.arange(n_a), "right")
        group_b = np.searchsorted(self.b_ends, np.arange(n_b), "right")
        parts = np.empty(2 * (n_a + n_b), object)
        at_a = np.arange(n_a) + np.append(0, self.b_ends)[group_a]
        at_b = np.arange(n_b) + self.a_ends[group_b]
        parts[2 * at_a], parts[2 * at_b] = texts_a[self.a], texts_b[self.b]
        parts[1::2] = ","
        parts[2 * at_a[self.a_ends - 1] + 1] = "|"
        parts[2 * at_b[self.b_ends - 1] + 1] = ";"
        return "".join(parts[:-1].tolist())


class Aligner:
    """Both vocabularies, and ``same``: for each id of the first the id of the same bytes
    in the second, or -1."""

    def __init__(self, files: Files):
        import sentencepiece

        self.files, self.whole = files, None
        with open(files.tokenizer, encoding="utf-8") as file:
            entries = json.load(file)["model"]["vocab"]
        byte = byte_of_symbol()
        self.a_bytes = [b""] * (max(entries.values()) + 1)
        for entry, i in entries.items():
            self.a_bytes[i] = bytes(byte[c] for c in entry)
        self.model = sentencepiece.SentencePieceProcessor(model_file=files.pieces)
        self.b_bytes = [self._piece_bytes(i) for i in range(self.model.get_piece_size())]
        first: dict[bytes, int] = {}
        for i in sorted(range(len(self.b_bytes)), key=self.model.is_byte):
            first.setdefault(self.b_bytes[i], i)
        self.same = np.array([first.get(whole, -1) for whole in self.a_bytes], np.int64)
        self.a_sizes, self.b_sizes = (np.array([len(w) for w in x]) for x in (self.a_bytes, self.b_bytes))
        self.a_texts, self.b_texts = (
            np.array([str(i) for i in range(len(x))], object) for x in (self.a_bytes, self.b_bytes)
        )
        self.ranks = packing.encoder(files.ranks)

    def _whole_ids(self, text: str) -> list[int]:
        """By the tokenizer file itself, which is opened when first needed."""
        from tokenizers import Tokenizer

        if self.whole is None:
            self.whole = Tokenizer.from_file(self.files.tokenizer)
            self.whole.encode_special_tokens = True
        return self.whole.encode(text, add_special_tokens=False).ids

    def _piece_bytes(self, i: int) -> bytes:
        piece = self.model.id_to_piece(i)
        return bytes([int(piece[3:5], 16)]) if self.model.is_byte(i) else piece.replace("▁", " ").encode()

    def align(self, text: str | None) -> Aligned | None:
        """None for a text that is missing or empty, or whose bytes one vocabulary changes."""
        if not text:
            return None
        spaced = f" {text}"
        if packing._blank(spaced):  # the matcher of the ranks fails on very long white space
            ids_a = self._whole_ids(spaced)
        else:
            ids_a = self.ranks.encode_ordinary(spaced)
        ids_b, wanted = self.model.encode(text), spaced.encode()
        for ids, known in ((ids_a, self.a_bytes), (ids_b, self.b_bytes)):
            if b"".join(map(known.__getitem__, ids)) != wanted:
                return None
        a, b = np.array(ids_a, np.int64), np.array(ids_b, np.int64)
        ends_a, ends_b = np.cumsum(self.a_sizes[a]), np.cumsum(self.b_sizes[b])
        ends = np.sort(np.concatenate([ends_a, ends_b]), kind="stable")
        ends = ends[np.diff(ends, append=0) != 0]
        at_a, at_b = np.searchsorted(ends_a, ends), np.searchsorted(ends_b, ends)
        both = (ends_a[at_a] == ends) & (ends_b[at_b] == ends)
        return Aligned(a, b, at_a[both] + 1, at_b[both] + 1, a[at_a], b[at_b])


def aligned(docs: DataFrame, files: Files | None = None) -> DataFrame:
    """``row`` (the columns of ``docs`` but the text), ``n_a``, ``n_b``, ``n_groups``,
    ``n_links`` and ``groups``, the ids of every group; nothing is shuffled."""
    files = files or public_files()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = Aligner(files)
        for batch in batches:
            for text, row in zip(batch.column("text"), batch.column("row"), strict=True):
                found = aligner.align(text.as_py())
                counts, groups = [0, 0, 0, 0], ""
                if found is not None:
                    counts = [len(x) for x in (found.a, found.b, found.a_ends, found.link_a)]
                    groups = found.groups(aligner.a_texts, aligner.b_texts)
                numbers = [pa.array([n], pa.int64()) for n in counts]
                columns = [pa.array([row.as_py()], row.type), *numbers, pa.array([groups])]
                yield pa.RecordBatch.from_arrays(columns, names=["row", *COUNTED, "groups"])

    given = _given(docs)
    row = given.schema["row"].dataType.simpleString()
    numbers = ", ".join(f"{c} bigint" for c in COUNTED)
    return given.mapInArrow(work, f"row {row}, {numbers}, groups string")


def _given(docs: DataFrame) -> DataFrame:
    others = [docs[f"`{c}`"] for c in docs.columns if c != "text"]
    return docs.select(F.struct(*others).alias("row"), docs.text)


class _Chunk:
    """The documents of a chunk, and for each document its different pairs as
    ``a * n_b + b``, and how often it holds each."""

    def __init__(self) -> None:
        self.rows: list = []
        self.numbers: list = []
        self.digests: list = []
        self.pairs: list[np.ndarray] = []
        self.times: list[np.ndarray] = []
        self.bytes = 0

    def add(self, aligner: Aligner, row, text: str | None) -> None:
        found = aligner.align(text)
        self.rows.append(row)
        self.bytes += len((text or "").encode())
        if found is None:
            self.numbers.append([0, 0, 0, 0])
            self.digests.append("")
            pairs = times = np.zeros(0, np.int64)
        else:
            groups = found.groups(aligner.a_texts, aligner.b_texts)
            self.numbers.append([len(x) for x in (found.a, found.b, found.a_ends, found.link_a)])
            self.digests.append(hashlib.sha256(groups.encode()).hexdigest())
            pairs, times = np.unique(found.link_a * len(aligner.b_bytes) + found.link_b, return_counts=True)
        self.pairs.append(pairs)
        self.times.append(times)

    def batch(self, number: int, aligner: Aligner, row_type: pa.DataType) -> pa.RecordBatch:
        held = np.concatenate(self.pairs)
        kinds, place, n_docs = np.unique(held, return_inverse=True, return_counts=True)
        a, b = np.divmod(kinds, len(aligner.b_bytes))
        same = aligner.same[a] == b
        counts = np.array(self.numbers, np.int64).reshape(-1, 4)
        docs = [pa.array(self.rows, row_type), *[pa.array(counts[:, i]) for i in range(4)]]
        docs = pa.StructArray.from_arrays(
            [*docs, pa.array(self.digests, pa.string())], names=["row", *COUNTED, "groups_sha256"]
        )

        def one(values: pa.Array) -> pa.Array:
            return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)

        columns = {
            "chunk": pa.array([number], pa.int64()),
            "docs": one(docs),
            "same": one(pa.array(a[same])),
            "same_docs": one(pa.array(n_docs[same])),
            "pairs": one(pa.array(kinds[~same])),
            "pair_docs": one(pa.array(n_docs[~same])),
            "is_same": pa.array([pack(same.astype(np.uint8))], pa.binary()),
            "sizes": pa.array([pack(np.array([len(p) for p in self.pairs], np.uint32))], pa.binary()),
            "places": pa.array([pack(np.diff(place.astype(np.uint32), prepend=np.uint32(0)))], pa.binary()),
            "times": pa.array([pack(np.concatenate(self.times).astype(np.uint32))], pa.binary()),
        }
        return pa.RecordBatch.from_pydict(columns)


CHUNK = (
    "same array<bigint>, same_docs array<bigint>, pairs array<bigint>, pair_docs array<bigint>, "
    "is_same binary, sizes binary, places binary, times binary"
)


def _chunks(docs: DataFrame, files: Files, chunk_bytes: int) -> DataFrame:
    """The documents in chunks as they are read, with the pairs of each chunk and the
    number of its documents that hold them; stored, so that texts are cut into tokens once."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        aligner, chunk, number = Aligner(files), _Chunk(), TaskContext.get().partitionId() << 33
        for batch in batches:
            row_type = batch.schema.field("row").type
            for text, row in zip(batch.column("text"), batch.column("row"), strict=True):
                chunk.add(aligner, row.as_py(), text.as_py())
                if chunk.bytes >= chunk_bytes:
                    yield chunk.batch(number, aligner, row_type)
                    chunk, number = _Chunk(), number + 1
        if chunk.rows:
            yield chunk.batch(number, aligner, row_type)

    given = _given(docs)
    row = given.schema["row"].dataType.simpleString()
    numbers = ",".join(f"{c}:bigint" for c in COUNTED)
    doc = f"docs array<struct<row:{row},{numbers},groups_sha256:string>>"
    return given.mapInArrow(work, f"chunk bigint, {doc}, {CHUNK}").checkpoint()


def _added(chunks: DataFrame, key: str, count: str) -> DataFrame:
    """``key`` and ``n``, the documents of all chunks that hold it."""
    each = chunks.select(F.inline(F.arrays_zip(key, count)))
    return each.groupBy(key).agg(F.sum(count).alias("n"))


class _Totals(NamedTuple):
    """For each id of the first vocabulary the documents that link it to the same bytes, and
    the most documents that link it to any id."""

    same: np.ndarray
    best: np.ndarray


def _totals(chunks: DataFrame, totals: DataFrame, n_a: int, n_b: int) -> _Totals:
    """Two vectors as long as the vocabulary; their rows are what reaches the driver."""
    same, best = np.zeros(n_a, np.int64), np.zeros(n_a, np.int64)
    for row in _added(chunks, "same", "same_docs").toArrow().to_pylist():
        same[row["same"]] = best[row["same"]] = row["n"]
    most = totals.groupBy(F.floor(F.col("pairs") / n_b).alias("a")).agg(F.max("n").alias("n"))
    for row in most.toArrow().to_pylist():
        best[row["a"]] = max(best[row["a"]], row["n"])
    return _Totals(same, best)


def _sizes(files: Files) -> tuple[int, int]:
    aligner = Aligner(files)
    return len(aligner.a_bytes), len(aligner.b_bytes)


def pair_counts(docs: DataFrame, files: Files | None = None, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """``a_id``, ``b_id`` and ``n_docs``, the documents that hold the pair linked."""
    files = files or public_files()
    shared_folder(docs.sparkSession)
    aligner = Aligner(files)
    n_b, chunks = len(aligner.b_bytes), _chunks(docs, files, chunk_bytes)
    twins = pa.table({"same": np.arange(len(aligner.same)), "b_id": aligner.same})
    same = _added(chunks, "same", "same_docs").join(docs.sparkSession.createDataFrame(twins), "same")
    others = _added(chunks, "pairs", "pair_docs").select(
        F.floor(F.col("pairs") / n_b).alias("a_id"), (F.col("pairs") % n_b).alias("b_id"), F.col("n").alias("n_docs")
    )
    return same.select(F.col("same").alias("a_id"), "b_id", F.col("n").alias("n_docs")).unionByName(others)


def _finish(totals: _Totals, n_b: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    def finish(chunk: pa.Table, told: pa.Table) -> pa.Table:
        packed = {c: unpack(chunk.column(c)[0].as_py()) for c in ("is_same", "sizes", "places", "times")}
        is_same = packed["is_same"] > 0
        n, best = np.zeros(len(is_same), np.int64), np.zeros(len(is_same), bool)
        a = chunk.column("same").combine_chunks().flatten().to_numpy()
        n[is_same], best[is_same] = totals.same[a], totals.same[a] == totals.best[a]
        others = np.zeros((~is_same).sum(), np.int64)
        others[told.column("place").to_numpy()] = told.column("n").to_numpy()
        pair_a = chunk.column("pairs").combine_chunks().flatten().to_numpy() // n_b
        n[~is_same], best[~is_same] = others, others == totals.best[pair_a]
        places = np.cumsum(packed["places"], dtype=np.uint32)
        times = packed["times"].astype(np.int64)
        until = np.cumsum(np.append(0, packed["sizes"].astype(np.int64)))
        sums = [np.append(0, np.cumsum(x)) for x in (times * best[places], times * n[places])]
        docs = chunk.column("docs").combine_chunks().flatten()
        columns = {name: docs.field(i) for i, name in enumerate(["row", *COUNTED, "groups_sha256"])}
        for name, summed in zip(("n_best", "count_sum"), sums, strict=True):
            columns[name] = pa.array(np.diff(summed[until]), pa.int64())
        return pa.table(columns)

    return finish


def linked(docs: DataFrame, files: Files | None = None, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """``row`` (the columns of ``docs`` but the text), the numbers of tokens, groups and
    links, the digest of the groups, ``count_sum``, the documents that hold each link added
    up, and ``n_best``, the links that no other link of their first id beats.

    A missing or empty text, and one whose bytes a vocabulary changes, has no tokens. A
    missing ``doc_id`` stays missing; a repeated row is a document of its own. An empty
    table gives no rows. A text is cut into tokens whole; one larger than a chunk is a
    chunk alone. Further columns stay in ``row``.
    """
    files = files or public_files()
    shared_folder(docs.sparkSession)
    n_a, n_b = _sizes(files)
    chunks = _chunks(docs, files, chunk_bytes)
    totals = _added(chunks, "pairs", "pair_docs").checkpoint()
    asked = chunks.select(F.col("chunk").alias("of"), F.posexplode("pairs").alias("place", "pairs"))
    told = asked.join(totals, "pairs").select("of", "place", "n")
    kept = chunks.select("chunk", "docs", "same", "pairs", "is_same", "sizes", "places", "times")
    row = chunks.schema["docs"].dataType.elementType["row"].dataType.simpleString()
    pairs = kept.groupBy("chunk").cogroup(told.groupBy("of"))
    finish = _finish(_totals(chunks, totals, n_a, n_b), n_b)
    return pairs.applyInArrow(finish, f"row {row}, {DIGEST}, n_best bigint, count_sum bigint")
