"""Words of texts as numpy arrays.

A word is a run of bytes other than space, tab, line feed, vertical tab, form feed and
carriage return. Those are single bytes in UTF-8, so texts are cut as bytes.
"""

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard

WORD = r"[^\x20\x09-\x0D]+"
SPACE = np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])
LOWER = np.where(
    (np.arange(256) >= ord("A")) & (np.arange(256) <= ord("Z")), np.arange(256) + 32, np.arange(256)
).astype(np.uint8)
#: Odd, so powers of it have inverses; 3 above a multiple of 8, so powers differ in low bits too.
BASE = 0x9E3779B97F4A7C1B
LANE = 8
#: Longer words are hashed one by one.
LONG_WORD = 8 * LANE
#: The lowest 0 to 8 bytes of 64 bits.
KEEP = np.array([(1 << 8 * n) - 1 for n in range(LANE + 1)], np.uint64)
SLICE = 1 << 20


class Words(NamedTuple):
    """Words of some texts: where each starts and ends in ``data``, and ``first``, the
    number of the first word of each text (one entry more than there are texts)."""

    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray

    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def text_of(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), self.counts())


def read_words(texts: list, lower: bool = False) -> Words:
    """Words of texts given as bytes; ``None`` is a text without words."""
    data = np.frombuffer(b"\n".join([*(t or b"" for t in texts), b""]), np.uint8)
    if lower:
        data = LOWER[data]
    gap = np.concatenate([[True], SPACE[data]])
    edges = np.flatnonzero(gap[1:] != gap[:-1])
    starts, ends = edges[::2], edges[1::2]
    sizes = np.array([len(t or b"") + 1 for t in texts], np.int64)
    first = np.searchsorted(starts, np.concatenate([[0], np.cumsum(sizes)]))
    return Words(data, starts, ends, first)


def pieces(texts: pa.Array) -> Iterator[tuple[int, int]]:
    """Ranges of rows whose texts have about a megabyte in all; a longer text is alone."""
    sizes = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False))
    a = 0
    while a < len(sizes):
        before = sizes[a - 1] if a else 0
        b = max(a + 1, int(np.searchsorted(sizes, before + SLICE, "right")))
        yield a, b
        a = b


def powers(n: int, base: int = BASE) -> np.ndarray:
    """1, base, base squared and so on, modulo 2**64."""
    factors = np.full(max(n, 1), base, np.uint64)
    factors[0] = 1
    return np.cumprod(factors, dtype=np.uint64)


def inverse_powers(n: int) -> np.ndarray:
    return powers(n, pow(BASE, -1, 1 << 64))


def mixed(x: np.ndarray) -> np.ndarray:
    """Spread every bit of 64-bit numbers over all bits; no two numbers meet."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(words: Words) -> np.ndarray:
    """A 64-bit hash of every word, from its bytes alone, eight bytes at a time."""
    sizes = words.ends - words.starts
    data = np.concatenate([words.data, np.zeros(LANE, np.uint8)])
    lanes = np.ndarray((len(words.data),), "<u8", data, strides=(1,))
    hashes = mixed(sizes.astype(np.uint64))
    for at in range(0, LONG_WORD, LANE):
        there = np.flatnonzero(sizes > at) if at else slice(None)
        part = lanes[words.starts[there] + at] & KEEP[np.minimum(sizes[there] - at, LANE)]
        hashes[there] = mixed(hashes[there] * np.uint64(BASE) + part)
        if at and not len(there):
            break
    for i in np.flatnonzero(sizes > LONG_WORD):
        hashes[i] = xxhash.xxh64_intdigest(words.data[words.starts[i] : words.ends[i]].tobytes())
    return hashes


def window_hashes(hashes: np.ndarray, width: int) -> np.ndarray:
    """Rolling polynomial hash of every run of ``width`` words, in pieces of bounded size."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    piece = min(n, SLICE)
    factor, back = powers(piece + width), inverse_powers(piece)
    out = np.empty(n, np.uint64)
    for a in range(0, n, piece):
        b = min(a + piece, n)
        terms = hashes[a : b + width - 1] * factor[: b - a + width - 1]
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(terms, dtype=np.uint64)])
        out[a:b] = (sums[width:] - sums[:-width]) * back[: b - a]
    return mixed(out)


def covered(starts_here: np.ndarray, width: int) -> np.ndarray:
    """Which words lie in a marked window of ``width`` words; one mark per word."""
    change = np.zeros(len(starts_here) + 1, np.int64)
    at = np.flatnonzero(starts_here)
    np.add.at(change, at, 1)
    np.add.at(change, np.minimum(at + width, len(starts_here)), -1)
    return np.cumsum(change[:-1]) > 0


def pack(numbers: np.ndarray) -> bytes:
    """Whole numbers as compressed bytes, the lowest byte of each first, then the next."""
    kind = numbers.dtype
    planes = np.ascontiguousarray(numbers).view(np.uint8).reshape(-1, kind.itemsize).T
    head = kind.str.encode().ljust(4)
    return head + zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def unpack(packed: bytes) -> np.ndarray:
    kind = np.dtype(packed[:4].decode().strip())
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(packed[4:]), np.uint8)
    return np.ascontiguousarray(planes.reshape(kind.itemsize, -1).T).view(kind).reshape(-1)


def pack_sorted(numbers: np.ndarray) -> bytes:
    """The same for ascending numbers, by their differences."""
    return pack(np.diff(numbers, prepend=numbers.dtype.type(0)))


def unpack_sorted(packed: bytes) -> np.ndarray:
    steps = unpack(packed)
    return np.cumsum(steps, dtype=steps.dtype)
