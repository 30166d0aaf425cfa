"""Katz backoff language model over words.

Documents become chunks of word numbers, written as a table. Counts of words, then of word
pairs and so on up to ``order`` words, are gathered level by level in buckets (see
``chunks``); each level is a table of its own, with a folder for each kind of row, and its
exchanges go before the next level starts. What follows an n-gram that only one chunk
holds, whether to learn from or to score, is counted in that chunk alone. A seen n-gram has its Good-Turing discounted
relative frequency; the mass that leaves over is spread over the words not seen after the
same history in proportion to the next shorter model, which makes every history's
probabilities add up to exactly one. Single words have add-half probabilities over the
vocabulary and one class for all unknown words.
"""

from collections.abc import Callable, Iterator
from functools import reduce
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from growthgrain.llm import chunks
from growthgrain.llm.stored import Tables
from growthgrain.llm.words import (
    BASE,
    mixed,
    pack,
    pack_sorted,
    read_words,
    unpack,
    unpack_sorted,
    word_hashes,
)

#: Counts above this are trusted and not discounted.
TRUSTED = 5
END = np.uint64(0xE5D0)
BEGIN = np.uint64(0xBE61)
#: A history is hot if it occurs this often and fills half an average bucket besides.
OFTEN = 1000
NOT_TRAINING = 1
FOLDS = 5
CHUNK_BYTES = 5_000_000
#: From three words on, where most n-grams differ, questions go out in so many rounds. Two
#: take less disk than one, and more time.
ROUNDS = 1

#: What rows between chunks and buckets hold. ASK: the n-grams of a chunk. COUNTS: their
#: counts and the continuations of their histories. WANT, PART, HOT: the same for
#: histories too frequent for one bucket, asked for, added up and answered apart.
ASK, COUNTS, WANT, PART, HOT, TOTALS = range(6)
PACKED = ["keys", "counts", "lower", "histories", "history", "hot", "seen", "alone", "full"]
NUMBERS = [f"total_{i}" for i in range(TRUSTED + 1)]
TOKENS = "sizes binary, training binary, words binary, tokens binary"
MESSAGE = "level int, kind int, bucket int, chunk bigint, " + ", ".join(
    [f"{c} binary" for c in PACKED] + [f"{c} bigint" for c in NUMBERS]
)
#: What a chunk needs of its answers to ask about the next level, and to score.
TO_ASK = ["level", "kind", "bucket", "chunk", "counts", "alone"]
TO_SCORE = [*TO_ASK, "full", "seen", "lower"]


def training(doc_id: Column) -> Column:
    """Documents the model learns from."""
    remainder = F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(FOLDS))
    return F.coalesce(remainder != NOT_TRAINING, F.lit(True))


def joined(history: np.ndarray, word: np.ndarray) -> np.ndarray:
    return mixed(history * np.uint64(BASE) + word)


class Tokens(NamedTuple):
    """Tokens of a chunk with an end token after each document: the number of each among the
    sorted hashes in ``words``, the hash of the 1, 2, ... tokens before it, and whether
    its document is for training."""

    words: np.ndarray
    tokens: np.ndarray
    histories: list[np.ndarray]
    training: np.ndarray
    first: np.ndarray


def cut_texts(texts: list[bytes | None], training: np.ndarray) -> list[bytes]:
    """What a chunk holds of its documents, in the columns of TOKENS."""
    words = read_words(texts, lower=True)
    first = words.first + np.arange(len(words.first))
    word = np.full(first[-1], END, np.uint64)
    inner = np.ones(len(word), bool)
    inner[first[1:] - 1] = False
    word[inner] = word_hashes(words)
    known, _, tokens = _distinct(word)
    sizes = np.diff(first).astype(np.uint32)
    return [
        pack(sizes),
        pack(training.astype(np.uint8)),
        pack_sorted(known),
        pack(tokens.astype(np.uint32)),
    ]


def read_tokens(table: pa.Table, order: int) -> Tokens:
    """The tokens of a chunk; of its rows, one has them."""
    sizes, training, words, tokens = (
        unpack(next(v for v in table.column(field.split()[0]).to_pylist() if v))
        for field in TOKENS.split(", ")
    )
    words = np.cumsum(words, dtype=np.uint64)
    first = np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])
    word = words[tokens]
    place = np.arange(len(word)) - np.repeat(first[:-1], np.diff(first))
    histories: list[np.ndarray] = []
    for back in range(1, order):
        before = np.full(len(word), BEGIN, np.uint64)
        before[back:] = np.where(place[back:] >= back, word[:-back], BEGIN)
        histories.append(joined(histories[-1], before) if histories else mixed(before))
    return Tokens(words, tokens, histories, np.repeat(training > 0, sizes), first)


def _cut(chunk_bytes: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Chunks of documents as they are read, a row for each; the first of a chunk has its tokens."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, table in enumerate(_together(batches, chunk_bytes)):
            found = cut_texts(chunks.texts_of(table), table.column("training").to_numpy())
            n = table.num_rows
            made = {
                "chunk": pa.array(np.full(n, (table.column("part")[0].as_py() << 32) + number)),
                "place": pa.array(np.arange(n), pa.int32()),
                "row": table.column("row"),
            }
            for field, value in zip(TOKENS.split(", "), found, strict=True):
                made[field.split()[0]] = pa.array([value] + [None] * (n - 1), pa.binary())
            yield from pa.table(made).to_batches()

    return cut


def _together(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.Table]:
    """Rows in the order they come, with texts of some ``size`` bytes at a time."""
    held: list[pa.RecordBatch] = []
    room = size
    for batch in batches:
        until = np.cumsum([len(t or b"") for t in chunks.texts_of(pa.table(batch))])
        a = 0
        while a < batch.num_rows:
            before = until[a - 1] if a else 0
            b = max(a + 1, int(np.searchsorted(until, before + room, "right")))
            held.append(batch.slice(a, b - a))
            room -= int(until[b - 1] - before)
            a = b
            if room <= 0 or a < batch.num_rows:
                yield pa.Table.from_batches(held)
                held, room = [], size
    if held:
        yield pa.Table.from_batches(held)


def discounts(counts_of_counts: np.ndarray) -> np.ndarray:
    """Katz's factor for counts 1 to TRUSTED, from the numbers of n-grams seen 1, 2, ...,
    TRUSTED + 1 times. Where those are too few for Good-Turing estimates between 0 and 1,
    half a count is taken off instead."""
    n = np.asarray(counts_of_counts, float)
    r = np.arange(1, TRUSTED + 1)
    absolute = (r - 0.5) / r
    if (n <= 0).any():
        return absolute
    common = (TRUSTED + 1) * n[TRUSTED] / n[0]
    found = ((r + 1) * n[1:] / (r * n[:-1]) - common) / (1 - common)
    return np.where((found > 0) & (found < 1), found, absolute)


def _bucket(keys: np.ndarray, n: int) -> np.ndarray:
    """Buckets go by the upper 24 bits, so they never part the n-grams of a history."""
    return ((keys >> np.uint64(40)).astype(np.int64) * n + n - 1) >> 24


def _parts(keys: np.ndarray, n: int) -> list[tuple[int, slice]]:
    """The buckets that sorted keys fall in, and where."""
    bucket = _bucket(keys, n)
    cuts = np.concatenate([[0], np.flatnonzero(np.diff(bucket)) + 1, [len(keys)]])
    return [(int(bucket[a]), slice(a, b)) for a, b in zip(cuts, cuts[1:], strict=False) if b > a]


def _pack_close(numbers: np.ndarray) -> bytes:
    """Numbers that differ little from the one before, by their differences without a sign."""
    steps = np.diff(numbers.astype(np.int32), prepend=np.int32(0))
    return pack(((steps << 1) ^ (steps >> 31)).astype(np.uint32))


def _unpack_close(packed: bytes) -> np.ndarray:
    steps = unpack(packed)
    return np.cumsum((steps >> 1).astype(np.int64) ^ -(steps & 1).astype(np.int64))


def _narrow(numbers: np.ndarray) -> np.ndarray:
    """Numbers from 0 on in 32 bits, if they fit."""
    fits = not len(numbers) or numbers.max() < 1 << 32
    return numbers.astype(np.uint32 if fits else np.uint64)


def _order(values: np.ndarray) -> np.ndarray:
    """Places of 64-bit values in ascending order. Values with their place in the low bits are
    sorted, which is faster than sorting places; then those that only the bits lost tell apart."""
    low = np.uint64((1 << len(values).bit_length()) - 1)
    order = np.sort(values & ~low | np.arange(len(values), dtype=np.uint64))
    order = (order & low).astype(np.int64)
    found = values[order]
    down = np.flatnonzero(found[1:] < found[:-1])
    if len(down):
        upper = found | low
        starts = np.flatnonzero(np.diff(upper, prepend=~upper[:1]))
        group = np.zeros(len(starts), bool)
        group[np.searchsorted(starts, down, "right") - 1] = True
        mixed_up = np.flatnonzero(np.repeat(group, np.diff(starts, append=len(values))))
        order[mixed_up] = order[mixed_up][np.argsort(found[mixed_up])]
    return order


def _distinct(values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted distinct values, a place where each stands, and which one stands at each place."""
    order = _order(values)
    found = values[order]
    new = np.ones(len(values), bool)
    new[1:] = found[1:] != found[:-1]
    back = np.empty(len(values), np.int64)
    back[order] = np.cumsum(new) - 1
    return found[new], order[new], back


def _row_sums(
    of: np.ndarray, counts: np.ndarray, few: np.ndarray, summed: np.ndarray, n: int
) -> np.ndarray:
    """A row for each of ``n`` groups: how many of its ``few`` counts are 1, 2, ..., TRUSTED,
    and the sum of those to be ``summed``."""
    width = TRUSTED + 1
    made = np.bincount(of[few] * width + counts[few] - 1, minlength=n * width).reshape(n, width)
    made[:, TRUSTED] = np.bincount(of[summed], counts[summed], n)
    return made


def _gathered(
    of: np.ndarray, counts: np.ndarray, lower: np.ndarray, n: int, level: int
) -> tuple[np.ndarray, np.ndarray]:
    """``seen`` and ``lower`` of ``n`` histories (see ``Level``) from the counts of the
    n-grams that continue them, ``of`` which history each is, and their ``lower`` counts."""
    there = counts > 0
    seen = _row_sums(of, counts, there & (counts <= TRUSTED), there, n)
    few = there & (lower <= TRUSTED) if level > 2 else np.zeros(len(counts), bool)
    below = _row_sums(of, lower, few, there & ~few, n)
    return seen, below


def _times(counts: np.ndarray) -> np.ndarray:
    """How many of the counts are 1, 2, ..., TRUSTED + 1."""
    return np.bincount(np.minimum(counts, TRUSTED + 2), minlength=TRUSTED + 3)[1 : TRUSTED + 2]


class Sizes(NamedTuple):
    """Words of the model, buckets, and how often a history occurs to be hot (see ``OFTEN``)."""

    order: int
    n_buckets: int
    often: int


class Level:
    """The distinct n-grams of one length in a chunk, by sorted key, and how often they occur
    in all. ``alone`` marks n-grams that no other chunk holds. N-grams after such a history,
    ``settled``, are counted at once; the others, ``asked``, in buckets. With ``round``, those
    of every so many buckets only."""

    def __init__(
        self,
        tokens: Tokens,
        level: int,
        below: "Level | None" = None,
        often: float = 0,
        n_buckets: int = 1,
        round: tuple[int, int] = (0, 1),
    ):
        self.tokens, self.level, self.n_buckets = tokens, level, n_buckets
        n, learnt = len(tokens.tokens), tokens.training
        if below is None:
            self.keys, self.back = tokens.words, tokens.tokens
            self.at = np.zeros(len(self.keys), np.int64)
            self.at[self.back] = np.arange(n)
            self.settled = np.zeros(len(self.keys), bool)
        else:
            self.shorter = below.counts[below.back]
            settled, self.hot = np.empty(n, bool), np.empty(n, bool)
            settled[1:] = below.alone[below.back[:-1]]
            self.hot[1:] = self.shorter[:-1] > often
            settled[tokens.first[:-1]], self.hot[tokens.first[:-1]] = False, True
            self.hot &= ~settled
            self.history = mixed(tokens.histories[level - 2])
            gram = joined(self.history, tokens.words[tokens.tokens])
            top = np.uint64(40)
            keys = np.where(
                self.hot, gram, (self.history >> top << top) | (gram >> np.uint64(24))
            )
            if round[1] > 1:
                here = np.flatnonzero(_bucket(keys, n_buckets) % round[1] == round[0])
                self.keys, at, self.back = _distinct(keys[here])
                self.at, learnt = here[at], learnt[here]
            else:
                self.keys, self.at, self.back = _distinct(keys)
            self.settled = settled[self.at]
        self.own = np.bincount(self.back, learnt, len(self.keys)).astype(np.int64)
        self.asked = np.flatnonzero(~self.settled)
        self.alone = self.settled.copy()
        self.counts = np.where(self.settled, self.own, 0)

    def lower_counts(self, of: np.ndarray) -> np.ndarray:
        """Counts of the n-grams ``of`` without their oldest word; of single words, twice
        their counts and one."""
        if self.level == 1:
            return np.zeros(len(of), np.int64)
        shorter = self.shorter[self.at[of]]
        return 2 * shorter + 1 if self.level == 2 else shorter

    def histories(self, of: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The sorted histories of the n-grams ``of``, a token after each, and the place of
        each n-gram's history among them."""
        if self.level == 1:
            some = min(len(of), 1)
            return np.zeros(some, np.uint64), self.at[of[:some]], np.zeros(len(of), np.int64)
        at = self.at[of]
        keys, first, place = _distinct(self.history[at])
        return keys, at[first], place

    def parts(self) -> list[tuple[int, np.ndarray]]:
        """Places of the n-grams asked for, by bucket."""
        keys = self.keys[self.asked]
        return [(b, self.asked[part]) for b, part in _parts(keys, self.n_buckets)]

    def hot_histories(self) -> tuple[np.ndarray, list[tuple[int, slice]]]:
        """Sorted histories counted in several buckets, and where those of a bucket are."""
        if self.level == 1:
            return np.zeros(0, np.uint64), []
        keys = np.unique(self.history[self.hot])
        return keys, _parts(keys, self.n_buckets)


def _numbers(packed: bytes) -> np.ndarray:
    """A row for each history (see ``_row_sums``)."""
    return unpack(packed).reshape(-1, TRUSTED + 1)


def _rare(counts: np.ndarray) -> np.ndarray:
    """Which counts tell that something was taken off after the history."""
    return (counts > 0) & (counts <= TRUSTED)


class Continued:
    """How the histories of the n-grams ``some`` of a level, those whose counts are not
    ``_rare``, are continued. ``times`` is how often in all, ``full`` whether no continuation
    occurs 1 to TRUSTED times. ``seen`` holds how many occur 1 to TRUSTED times, and ``times``.
    ``lower`` tells of the same continuations after the history without its oldest word: how
    many occur 1 to TRUSTED times there, and how often the others do in all; on level 2, where
    that history is empty, only twice their counts and one for each. The last two are there for
    the histories of unseen n-grams, and those hot or settled."""

    def __init__(self, found: Level, times: np.ndarray, told: list[dict]):
        self.some = np.flatnonzero(~_rare(found.counts))
        keys, self.at, self.of = found.histories(self.some)
        self.times = times[self.at]
        hot = found.hot[self.at]
        settled = np.zeros(len(keys), bool)
        settled[self.of] = found.settled[self.some]
        self.seen, self.lower = self._settled(found, keys)
        self.full = np.zeros(len(keys), bool)
        places = {b: np.arange(p.start, p.stop) for b, p in _parts(keys, found.n_buckets)}
        places = {b: p[~hot[p] & ~settled[p]] for b, p in places.items()}
        unseen = np.zeros(len(keys), bool)
        unseen[self.of[found.counts[self.some] == 0]] = True
        for a in told:
            if a["kind"] == COUNTS and a["full"]:
                here = places.get(a["bucket"], np.zeros(0, np.int64))
                self.full[here] = np.unpackbits(unpack(a["full"]), count=len(here)) > 0
                here = here[unseen[here]]
                self.seen[here] = _numbers(a["seen"])
                self.lower[here] = _numbers(a["lower"])
        hot_keys, parts = found.hot_histories()
        place, mine = dict(parts), np.flatnonzero(hot)
        mine_at = np.searchsorted(hot_keys, keys[mine])
        for a in told:
            if a["kind"] == HOT:
                part = place[a["bucket"]]
                here = (mine_at >= part.start) & (mine_at < part.stop)
                at = mine_at[here] - part.start
                self.seen[mine[here]] = _numbers(a["seen"])[at]
                self.lower[mine[here]] = _numbers(a["lower"])[at]
        whole = hot | settled
        self.full[whole] = ~self.seen[whole, :-1].any(axis=1)
        self.full &= self.times > 0  # nothing was taken off: make room for one more
        self.room = self.times + self.full

    def _settled(self, found: Level, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """What the chunk itself counts after the histories ``keys``."""
        mine = np.flatnonzero(found.settled & (found.own > 0))
        history = found.history[found.at[mine]]
        of = np.minimum(np.searchsorted(keys, history), max(len(keys) - 1, 0))
        there = np.flatnonzero(keys[of] == history) if len(keys) else np.zeros(0, np.int64)
        mine, of = mine[there], of[there]
        return _gathered(of, found.own[mine], found.lower_counts(mine), len(keys), found.level)


class Reader:
    """A chunk with the answers it has had and the totals of each level. Levels follow from
    the answers to lower ones."""

    def __init__(self, table: pa.Table, told: list[dict], totals: list[list[int]], sizes: Sizes):
        self.sizes = sizes
        self.tokens = read_tokens(table, min(sizes.order, len(totals) + 1))
        self.totals = dict(enumerate(totals, 1))
        self.told = {level: [a for a in told if a["level"] == level] for level in self.totals}
        self.levels: list[Level] = []
        for level in self.totals:
            found = self.next_level()
            parts = dict(found.parts())
            for a in self.told[level]:
                if a["kind"] == COUNTS:
                    part = parts[a["bucket"]]
                    found.counts[part] = unpack(a["counts"])
                    found.alone[part] = np.unpackbits(unpack(a["alone"]), count=len(part)) > 0
            self.levels.append(found)

    def next_level(self, round: int = 0, rounds: int = 1) -> Level:
        level, n = len(self.levels) + 1, self.sizes.n_buckets
        if level == 1:
            return Level(self.tokens, 1, n_buckets=n)
        often = self.totals[1][0] / (2 * n) + self.sizes.often
        return Level(self.tokens, level, self.levels[-1], often, n, (round, rounds))

    @property
    def mass(self) -> float:
        """What the half counts of all words and of the unknown class add up to."""
        return self.totals[1][0] + 0.5 * (self.totals[1][1] + 1)

    def log10(self) -> Iterator[np.ndarray]:
        """log10 of the probability of every token given the 0, 1, ... tokens before it."""
        words, first = self.levels[0], self.tokens.first[:-1]
        logs = np.log10((words.counts + 0.5) / self.mass)[words.back]
        yield logs
        room = np.zeros(0)
        for level, found in enumerate(self.levels[1:], 2):
            # A history is continued as often as it occurs, as it ends no document.
            times = np.empty(len(logs), np.int64)
            times[1:] = found.shorter[:-1]
            times[first] = words.counts[np.searchsorted(words.keys, END)]
            after = Continued(found, times, self.told[level])
            factor = np.append(discounts(self.totals[level]), 1.0)
            rooms = times[found.at]
            rooms[after.some] = after.room[after.of]
            made, seen = np.empty(len(rooms)), np.flatnonzero(found.counts)
            r = found.counts[seen]
            made[seen] = np.log10(factor[np.minimum(r, TRUSTED + 1) - 1] * r / rooms[seen])
            unseen = np.flatnonzero(found.counts[after.some] == 0)
            more = self._backoff(level, after, factor, room)[after.of[unseen]]
            unseen = after.some[unseen]
            made[unseen] = logs[found.at[unseen]] + more
            logs, room = made[found.back], rooms[found.back]
            yield logs

    def _backoff(
        self, level: int, after: Continued, factor: np.ndarray, room: np.ndarray
    ) -> np.ndarray:
        """log10 of what a probability of the next shorter model is multiplied by after each
        history; ``room`` is that of the shorter history before each token."""
        rare = np.arange(1, TRUSTED + 1)
        with np.errstate(divide="ignore", invalid="ignore"):
            left = np.einsum("ij,j->i", after.seen[:, :-1] * rare, 1 - factor[:-1])
            left = np.where(after.full, 1.0, left)
            if level == 2:
                lower = after.lower[:, -1] / (2 * self.mass)
            else:
                below = discounts(self.totals[level - 1]) * rare
                lower = np.einsum("ij,j->i", after.lower[:, :-1], below) + after.lower[:, -1]
                lower = lower / room[after.at]
            found = np.log10(left / after.room) - np.log10(1 - lower)
        return np.where(after.times > 0, found, 0.0)

    def ask(self, chunk: int, round: int, rounds: int) -> list[dict]:
        """Questions to the buckets of a round, every ``rounds``-th bucket."""
        level, found = len(self.levels) + 1, self.next_level(round, rounds)
        lower = _narrow(found.lower_counts(np.arange(len(found.keys))))
        histories, at, of = found.histories(found.asked)
        hot = found.hot[at] if level > 1 else np.zeros(len(at), bool)
        place = np.zeros(len(found.keys), np.uint64)
        place[found.asked] = of
        rows = []
        for b, part in found.parts():
            if b % rounds != round:
                continue
            own, _, history = _distinct(place[part])
            own = own.astype(np.int64)
            rows.append(
                {"kind": ASK, "bucket": b, "keys": pack_sorted(found.keys[part])}
                | {"counts": pack(found.own[part].astype(np.uint32))}
                | {"lower": pack(lower[part])}
                | {"histories": pack_sorted(histories[own])}
                | {"history": _pack_close(history)}
                | {"hot": pack(hot[own].astype(np.uint8))}
            )
        if found.settled.any():
            times = dict(zip(NUMBERS, map(int, _times(found.own[found.settled])), strict=True))
            rows.append({"kind": TOTALS, "bucket": chunk % self.sizes.n_buckets} | times)
        if round == 0:
            keys, parts = found.hot_histories()
            rows += [
                {"kind": WANT, "bucket": b, "histories": pack_sorted(keys[part])}
                for b, part in parts
            ]
        return [{"level": level, "chunk": chunk} | row for row in rows]


def _message(rows: list[dict]) -> pa.Table:
    names = [field.split()[0] for field in MESSAGE.split(", ")]
    return chunks.as_table({c: [row.get(c) for row in rows] for c in names}, MESSAGE)


def _count(table: pa.Table) -> pa.Table:
    """A bucket: count its n-grams over all chunks and tell each chunk its own."""
    asked = table.to_pylist()
    forwarded = [a for a in asked if a["kind"] != ASK]
    asked = [a for a in asked if a["kind"] == ASK]
    if not asked:
        return _message(forwarded)
    level, bucket = asked[0]["level"], asked[0]["bucket"]
    until = np.cumsum([0, *(len(unpack(a["counts"])) for a in asked)])
    keys = np.concatenate([unpack_sorted(a["keys"]) for a in asked])
    owns = [unpack_sorted(a["histories"]) for a in asked]
    history = np.concatenate(
        [o[_unpack_close(a["history"])] for o, a in zip(owns, asked, strict=True)]
    )
    _, one, gram = _distinct(keys)
    del keys
    counts = np.concatenate([unpack(a["counts"]) for a in asked])
    counts = np.bincount(gram, counts, len(one)).astype(np.int64)
    lower = np.concatenate([unpack(a["lower"]) for a in asked])[one].astype(np.int64)
    history = history[one]
    if level == 1:
        total = np.array([counts.sum(), (counts > 0).sum(), *[0] * (TRUSTED - 1)])
    else:
        total = _times(counts)
    rows = [
        {"level": level, "kind": TOTALS, "bucket": bucket}
        | dict(zip(NUMBERS, map(int, total), strict=True)),
        *forwarded,
    ]
    histories, _, of = _distinct(history)
    alone = np.bincount(gram) == 1
    full = np.bincount(of[_rare(counts)], minlength=len(histories)) == 0
    hot = np.zeros(len(histories), bool)
    for own, a in zip(owns, asked, strict=True):
        hot[np.searchsorted(histories, own[unpack(a["hot"]) > 0])] = True
    # The numbers of a history are told to those who have an n-gram after it that is unseen.
    wanted = hot.copy()
    wanted[of[counts == 0]] = True
    place = np.cumsum(wanted) - 1
    wanted = np.flatnonzero(wanted[of])
    seen, mass = _gathered(
        place[of[wanted]], counts[wanted], lower[wanted], place[-1] + 1, level
    )
    for i, a in enumerate(asked):
        grams = gram[until[i] : until[i + 1]]
        told = {"level": level, "kind": COUNTS, "bucket": bucket, "chunk": a["chunk"]}
        told["counts"] = pack(counts[grams].astype(np.uint32))
        told["alone"] = pack(np.packbits(alone[grams]))
        some = grams[~_rare(counts[grams])]
        unseen = np.unique(of[some[counts[some] == 0]])
        some = np.unique(of[some])
        some = some[~hot[some]]
        if level > 1 and len(some):
            told["full"] = pack(np.packbits(full[some]))
            unseen = place[unseen[~hot[unseen]]]
            told |= {"seen": pack(_narrow(seen[unseen])), "lower": pack(mass[unseen])}
        rows.append(told)
    if hot.any():
        rows.append(
            {"level": level, "kind": PART, "histories": pack_sorted(histories[hot])}
            | {"seen": pack(seen[place[hot]]), "lower": pack(mass[place[hot]])}
        )
    return _message(rows)


def _split_parts(n_buckets: int) -> Callable[[pa.Table], pa.Table]:
    """Send each hot history's numbers from one bucket on to the bucket of the history."""

    def split(batches):
        for batch in batches:
            rows = []
            for a in batch.to_pylist():
                if a["kind"] == WANT:
                    rows.append(a)
                    continue
                histories = unpack_sorted(a["histories"])
                seen, lower = _numbers(a["seen"]), _numbers(a["lower"])
                for b, part in _parts(histories, n_buckets):
                    rows.append(
                        {"level": a["level"], "kind": PART, "bucket": b}
                        | {"histories": pack_sorted(histories[part])}
                        | {"seen": pack(seen[part]), "lower": pack(lower[part])}
                    )
            yield from _message(rows).to_batches()

    return split


def _add_parts(table: pa.Table) -> pa.Table:
    """A bucket of hot histories: add up their parts and tell each chunk that wants them."""
    rows = table.to_pylist()
    parts, wants = ([a for a in rows if a["kind"] == kind] for kind in (PART, WANT))
    if not wants or not parts:
        return _message([])
    own = np.concatenate([unpack_sorted(a["histories"]) for a in parts])
    histories, of = np.unique(own, return_inverse=True)
    seen, lower = (np.zeros((len(histories), TRUSTED + 1), np.int64) for _ in range(2))
    for name, total in (("seen", seen), ("lower", lower)):
        np.add.at(total, of, np.concatenate([_numbers(a[name]) for a in parts]))
    told = []
    for a in wants:
        mine = np.searchsorted(histories, unpack_sorted(a["histories"]))
        told.append(
            {"level": a["level"], "kind": HOT, "bucket": a["bucket"], "chunk": a["chunk"]}
            | {"seen": pack(seen[mine]), "lower": pack(lower[mine])}
        )
    return _message(told)


class Told(NamedTuple):
    """What chunks are told about one level, and the level's totals."""

    rows: DataFrame
    totals: list[int]


def _told(tables: Tables, level: int, asked: list[DataFrame], n: int) -> Told:
    """The tables of a level: all n-grams that chunks asked for, counted in buckets. Each
    round of questions is counted before the next is asked."""
    rounds = []
    for i, round in enumerate(asked):
        counted = round.groupBy("bucket").applyInArrow(_count, MESSAGE)
        rounds.append(tables.write(f"counts-{level}/round={i}", counted, by="kind"))
    counted = reduce(DataFrame.unionByName, rounds)
    total = counted.where(F.col("kind") == TOTALS).agg(
        *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in NUMBERS]
    )
    parts = counted.where(F.col("kind").isin(PART, WANT)).mapInArrow(_split_parts(n), MESSAGE)
    hot = parts.groupBy("bucket").applyInArrow(_add_parts, MESSAGE)
    hot = tables.write(f"frequent-{level}", hot)
    told = counted.where(F.col("kind") == COUNTS).unionByName(hot)
    return Told(told.select(*TO_SCORE), list(total.first()))


def _ask(
    totals: list[list[int]], sizes: Sizes, round: int, rounds: int
) -> Callable[[pa.Table, pa.Table], pa.Table]:
    def ask(table: pa.Table, told: pa.Table) -> pa.Table:
        chunk = table.column("chunk")[0].as_py()
        return _message(Reader(table, told.to_pylist(), totals, sizes).ask(chunk, round, rounds))

    return ask


SCORES = "n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double"


def _score(totals: list[list[int]], sizes: Sizes) -> Callable[[pa.Table, pa.Table], pa.Table]:
    def score(table: pa.Table, told: pa.Table) -> pa.Table:
        table = table.sort_by("place")
        reader = Reader(table, told.to_pylist(), totals, sizes)
        first, words = reader.tokens.first, reader.levels[0]
        known = words.counts[words.back] > 0
        sums = [np.add.reduceat(logs, first[:-1]) for logs in reader.log10()]
        made = {
            "row": table.column("row"),
            "n_tokens": pa.array(np.diff(first), pa.int64()),
            "n_known": pa.array(np.add.reduceat(known, first[:-1], dtype=np.int64)),
            "train_tokens": pa.array(np.full(len(first) - 1, reader.totals[1][0])),
            "base_score": pa.array(sums[0]),
            "score": pa.array(sums[-1]),
        }
        return pa.table(made)

    return score


def scores(
    docs: DataFrame,
    train: Column,
    order: int = 2,
    chunk_bytes: int = CHUNK_BYTES,
    often: int = OFTEN,
    rounds: int = ROUNDS,
) -> DataFrame:
    """``row`` (the columns of ``docs`` but the text) and the scores of the text under a
    model of ``order`` words learned from the rows for which ``train`` holds.

    ``score`` is log10 of the model's probability of the text, ``base_score`` that of
    single words. A null text is empty and has the end token only; a very long one ends
    its chunk and is held whole by one task. Repeated rows are learned from and scored each; an
    empty table gives no rows. With nothing to learn from, everything is unknown and has
    probability one. Words are told apart by 64-bit hashes.

    ``chunk_bytes`` is the text a task holds, ``often`` how often a history must occur to be
    counted in several buckets, ``rounds`` in how many steps n-grams of three words and more
    are counted. The tables of counts are written when this is called, and dropped once the scores are.
    """
    n = chunks.chunk_count(docs, chunk_bytes)
    sizes = Sizes(order, n, often)
    tables = Tables(docs.sparkSession, "katz")
    row = F.struct(*[docs[f"`{c}`"] for c in docs.columns if c != "text"]).alias("row")
    training = F.coalesce(train, F.lit(False)).alias("training")
    read = docs.select(row, docs.text, training, F.spark_partition_id().alias("part"))
    row = read.schema["row"].dataType.simpleString()
    texts = read.mapInArrow(_cut(chunk_bytes), f"chunk bigint, place int, row {row}, {TOKENS}")
    n_files = max(n, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    texts = tables.write_bucketed("tokens", texts, "chunk", n_files)
    tokens = texts.where("place = 0").drop("place", "row")
    answers = docs.sparkSession.createDataFrame([], MESSAGE).select(*TO_SCORE)
    told: list[Told] = []
    for level in range(1, order + 1):
        known = reduce(DataFrame.unionByName, [t.rows for t in told], answers)
        known = known.where(F.col("kind") == COUNTS).select(*TO_ASK)
        steps = 1 if level < 3 else rounds
        asked = [
            chunks.by_chunk(tokens, known, _ask([t.totals for t in told], sizes, i, steps), MESSAGE)
            for i in range(steps)
        ]
        told.append(_told(tables, level, asked, n))
    known = reduce(DataFrame.unionByName, [t.rows for t in told], answers)
    score = _score([t.totals for t in told], sizes)
    found = tables.write("scores", chunks.by_chunk(texts, known, score, f"row {row}, {SCORES}"))
    for name in ["tokens", *[f"{kind}-{i}" for i in range(1, order + 1) for kind in ("counts", "frequent")]]:
        tables.drop(name)
    return found
