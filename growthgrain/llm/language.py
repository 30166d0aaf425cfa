"""Language identification by piece unigrams with the segmentation summed out.

Each language has a probability for every piece of a fixed public vocabulary. The
probability of a word is the sum over all ways to cut it into pieces, by a forward pass
over its bytes; a text is the product of its words, and the languages' shares of the
total are the scores.
"""

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from growthgrain.llm.words import KEEP, LANE, BASE, Words, mixed, pieces, read_words, word_hashes

HELD_OUT = 0
FOLDS = 5
UNKNOWN = "und"
#: Longer words are cut every so many bytes; keeps probabilities within a double.
LONGEST = 32
#: Share of the probability that is the same for all pieces.
FLOOR = 1e-3
#: A model holds a number for each piece and language, and every executor holds it.
MOST_LANGUAGES = 1000
#: Counts of this many languages are held at once in a task.
HELD_LANGUAGES = 64
#: Numbers in the forward table of the words that are scored together.
MOST_SUMS = 4_000_000
#: Numbers of words that are kept from one megabyte to the next; beyond, those of the last.
MOST_KEPT = 4_000_000


def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def held_out(doc_id: Column) -> Column:
    remainder = F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(FOLDS))
    return F.coalesce(remainder == HELD_OUT, F.lit(False))


def has_letter(text: str) -> bool:
    """Whether a character is a letter; numbers that look like some (Ⅳ, ½, ²) are not."""
    return any(map(str.isalpha, text))


def _lanes(data: np.ndarray) -> np.ndarray:
    """The eight bytes from every place on."""
    padded = np.concatenate([data, np.zeros(4 * LANE, np.uint8)])
    return np.ndarray((len(data) + 3 * LANE,), "<u8", padded, strides=(1,))


def _span_keys(lanes: np.ndarray, at: np.ndarray, size: int) -> np.ndarray:
    """Numbers for the strings of ``size`` bytes at some places."""
    key = lanes[at] & KEEP[min(size, LANE)]
    for on in range(LANE, size, LANE):
        key = mixed(key * np.uint64(BASE) + (lanes[at + on] & KEEP[min(size - on, LANE)]))
    return key


class Vocabulary:
    """Pieces by length in bytes; a word begins with a space, any byte is a piece too."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.size = self.model.vocab_size()
        texts: dict[int, list[tuple[bytes, int]]] = defaultdict(list)
        self.bytes = np.zeros(256, np.int64)
        for i in range(self.size):
            piece = self.model.id_to_piece(i)
            if self.model.is_byte(i):
                self.bytes[int(piece[3:5], 16)] = i
            elif not self.model.is_control(i) and not self.model.is_unknown(i):
                text = piece.replace("▁", " ").encode()
                texts[len(text)].append((text, i))
        self.tables = {}
        for size, some in sorted(texts.items()):
            data = np.frombuffer(b"".join(t for t, _ in some), np.uint8)
            keys = _span_keys(_lanes(data), np.arange(len(some)) * size, size)
            order = np.argsort(keys)
            self.tables[size] = keys[order], np.array([i for _, i in some])[order]

    def counts(self, words: list[str], times: np.ndarray) -> np.ndarray:
        """How often each piece occurs when the vocabulary's own rule cuts the words."""
        found = self.model.encode(words)
        each = np.fromiter(map(len, found), np.int64, len(found))
        ids = np.fromiter((i for ids in found for i in ids), np.int64, each.sum())
        return np.bincount(ids, np.repeat(times, each), self.size)

    def forward(self, words: Words, some: np.ndarray, chance: np.ndarray) -> np.ndarray:
        """Natural log of the probability of some words in each language."""
        sizes = words.ends[some] - words.starts[some] + 1
        cut = -(-sizes // LONGEST)  # parts of each word
        part = np.arange(cut.sum()) - np.repeat(np.cumsum(cut) - cut, cut)
        length = np.minimum(np.repeat(sizes, cut) - part * LONGEST, LONGEST)
        begin = np.cumsum(length) - length
        place = np.arange(length.sum()) - np.repeat(begin, length)
        source = np.repeat(np.repeat(words.starts[some] - 1, cut) + part * LONGEST, length) + place
        data = np.where(np.repeat(part, length) + place > 0, words.data[source], 0x20)
        data = data.astype(np.uint8)
        left = np.repeat(length, length) - place
        lanes, edges = _lanes(data), {}
        for size, (keys, ids) in self.tables.items():
            at = np.flatnonzero(left >= size)
            wanted = _span_keys(lanes, at, size)
            found = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
            hit = keys[found] == wanted
            edges[size] = at[hit], ids[found[hit]]
        single = chance[self.bytes]
        at, ids = edges.pop(1)
        step = single[data]
        step[at] += chance[ids]
        owner = np.repeat(np.arange(len(length)), length)
        by_place = {
            size: np.split(
                order := np.argsort(place[at], kind="stable"),
                np.searchsorted(place[at][order], np.arange(1, LONGEST)),
            )
            for size, (at, _) in edges.items()
        }
        sums = np.zeros((LONGEST + 1, len(length), chance.shape[1]))
        sums[0] = 1
        for begins in range(length.max(initial=0)):
            there = np.flatnonzero(length > begins)
            sums[begins + 1, there] += sums[begins, there] * step[begin[there] + begins]
            for size, (at, ids) in edges.items():
                chosen = by_place[size][begins]
                if len(chosen):
                    word = owner[at[chosen]]
                    sums[begins + size, word] += sums[begins, word] * chance[ids[chosen]]
        logs = np.log(sums[length, np.arange(len(length))])
        return np.add.reduceat(logs, np.cumsum(cut) - cut) if len(cut) else logs


def _distinct(words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The hash and one place of every distinct word, and for every word which one it is."""
    return np.unique(word_hashes(words), return_index=True, return_inverse=True)


class _WordScores:
    """Logs of words by language, kept from one megabyte of a task to the next."""

    def __init__(self, vocabulary: Vocabulary, chance: np.ndarray):
        self.vocabulary, self.chance = vocabulary, chance
        self._keep(np.zeros(0, np.uint64), np.zeros((0, chance.shape[1])))

    def _keep(self, hashes: np.ndarray, logs: np.ndarray) -> None:
        order = np.argsort(hashes)
        self.hashes, self.logs = hashes[order], logs[order]

    def of(self, words: Words, hashes: np.ndarray, at: np.ndarray) -> np.ndarray:
        """One row for each of some different words, given by hash and place."""
        langs = self.chance.shape[1]
        place = np.searchsorted(self.hashes, hashes)
        known = np.zeros(len(hashes), bool)
        inside = place < len(self.hashes)
        known[inside] = self.hashes[place[inside]] == hashes[inside]
        logs = np.empty((len(hashes), langs))
        logs[known] = self.logs[place[known]]
        new = np.flatnonzero(~known)
        few = max(1, MOST_SUMS // (LONGEST * max(1, langs)))
        for i in range(0, len(new), few):
            some = new[i : i + few]
            logs[some] = self.vocabulary.forward(words, at[some], self.chance)
        if (len(self.hashes) + len(new)) * max(1, langs) > MOST_KEPT:
            self._keep(hashes, logs)
        else:
            self._keep(np.append(self.hashes, hashes[new]), np.concatenate([self.logs, logs[new]]))
        return logs


def piece_counts(docs: DataFrame, path: str) -> DataFrame:
    """(``lang``, ``piece``, ``n``): pieces in the texts of each language."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = Vocabulary(path)
        held: dict[str, np.ndarray] = {}

        def emptied() -> Iterator[pa.RecordBatch]:
            for lang, total in held.items():
                there = np.flatnonzero(total)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([lang] * len(there), pa.string()),
                        pa.array(there, pa.int32()),
                        pa.array(total[there].astype(np.int64)),
                    ],
                    names=["lang", "piece", "n"],
                )
            held.clear()

        for batch in batches:
            texts = batch.column("text").cast(pa.binary())
            langs = np.array(batch.column("lang").to_pylist(), object)
            for lang in dict.fromkeys(langs):
                own = texts.take(pa.array(np.flatnonzero(langs == lang)))
                for a, b in pieces(own):
                    words = read_words(own[a:b].to_pylist())
                    _, at, which = _distinct(words)
                    spans = zip(words.starts[at], words.ends[at], strict=True)
                    distinct = [words.data[s:e].tobytes().decode("utf-8") for s, e in spans]
                    found = vocabulary.counts(distinct, np.bincount(which, minlength=len(at)))
                    held[lang] = held.get(lang, 0) + found
                if len(held) >= HELD_LANGUAGES:
                    yield from emptied()
        yield from emptied()

    counts = docs.select("lang", "text").mapInArrow(count, "lang string, piece int, n bigint")
    return counts.groupBy("lang", "piece").agg(F.sum("n").alias("n"))


def learn(docs: DataFrame, path: str) -> tuple[list[str], np.ndarray]:
    """Languages, and the probability of each piece (row) in each language (column).

    Learns from rows that have a text and a ``lang``. What reaches the driver is one
    number for each piece and language.
    """
    counts = piece_counts(docs.where("text is not null and lang is not null"), path)
    size = Vocabulary(path).size
    found = counts.limit(size * MOST_LANGUAGES + 1).toPandas()
    langs = sorted(found["lang"].unique())
    if len(langs) > MOST_LANGUAGES or len(found) > size * MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    table = np.zeros((size, len(langs)))
    if langs:
        column = np.searchsorted(langs, found["lang"].to_numpy(str))
        table[found["piece"].to_numpy(int), column] = found["n"].to_numpy(float)
    share = table / np.maximum(table.sum(axis=0), 1)
    return langs, (1 - FLOOR) * share + FLOOR / size


def predict(docs: DataFrame, train: Column, path: str | None = None) -> DataFrame:
    """``doc_id``, ``lang_pred`` and ``score`` of every row of ``docs``, from its text.

    Learned from the rows for which ``train`` holds. A text that is null or has no letter
    is ``und`` with score 0, as is every text if there is nothing to learn from. Ties go
    to the first language by name. Repeated rows are predicted each, an empty table gives
    no rows, and further columns are not read. Texts are read whole, a megabyte or one
    text at a time.
    """
    path = path or vocabulary_path()
    learned = docs.where(train).select(docs.lang.cast("string").alias("lang"), docs.text)
    langs, chance = learn(learned, path)
    model = docs.sparkSession.sparkContext.broadcast((langs, chance))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = Vocabulary(path)
        langs, chance = model.value
        scores_of = _WordScores(vocabulary, chance)
        for batch in batches:
            texts = batch.column("text").cast(pa.binary())
            for a, b in pieces(texts):
                some = texts[a:b].to_pylist()
                words = read_words(some)
                hashes, at, which = _distinct(words)
                logs = scores_of.of(words, hashes, at)
                owner = words.text_of()
                total = np.zeros((len(some), len(langs)))
                for i in range(len(langs)):
                    total[:, i] = np.bincount(owner, logs[which, i], len(some))
                names, scores = [], []
                for text, log in zip(some, total, strict=True):
                    if not langs or not text or not has_letter(text.decode("utf-8")):
                        names.append(UNKNOWN)
                        scores.append(0.0)
                        continue
                    best = int(np.argmax(log))
                    names.append(langs[best])
                    scores.append(float(1 / np.exp(log - log[best]).sum()))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id").slice(a, b - a),
                        pa.array(names, pa.string()),
                        pa.array(scores, pa.float64()),
                    ],
                    names=["doc_id", "lang_pred", "score"],
                )

    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, lang_pred string, score double"
    return docs.select(docs.doc_id, docs.text).mapInArrow(read, schema)
