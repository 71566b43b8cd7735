"""Words of whole texts as numpy arrays: where they are, and 64-bit hashes of words and word spans.

All texts of a piece of a batch are cut at once. A span's hash is a difference of prefix sums, so the
hash of any run of words costs the same however long it is. Sums wrap at 64 bits; the tables and
factors are odd random numbers from a fixed seed, the same on every executor.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa

#: Bytes of ASCII space: \x20 and \x09 to \x0D.
SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: A-Z become a-z, every other byte stays.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20

U = np.uint64
_SEEDED = np.random.Generator(np.random.PCG64(20240229))
_BYTE = _SEEDED.integers(0, 2**64, 256, dtype=np.uint64) | U(1)
_BYTE_FACTOR, WORD_FACTOR, SECOND_FACTOR = (int(x) | 1 for x in _SEEDED.integers(0, 2**64, 3, dtype=np.uint64))


@lru_cache(maxsize=16)
def _powers(factor: int, size: int) -> np.ndarray:
    base = np.full(size, factor, dtype=np.uint64)
    base[0] = 1
    return np.cumprod(base, dtype=np.uint64)


def powers(factor: int, size: int) -> np.ndarray:
    """factor ** 0 ... factor ** (size - 1), modulo 2 ** 64."""
    return _powers(factor, 1 << max(16, (size - 1).bit_length()))[:size]


def inverse(factor: int) -> int:
    return pow(factor, -1, 2**64)


def mix(x: np.ndarray) -> np.ndarray:
    """A one-to-one scrambling of 64-bit values."""
    x = x ^ (x >> U(33))
    x *= U(0xFF51AFD7ED558CCD)
    x ^= x >> U(33)
    x *= U(0xC4CEB9FE1A85EC53)
    x ^= x >> U(33)
    return x


class Prefix:
    """Prefix sums over a sequence of hashes; ``span(a, b)`` hashes the items a to b - 1."""

    def __init__(self, items: np.ndarray, factor: int = WORD_FACTOR):
        self.sums = np.zeros(len(items) + 1, dtype=np.uint64)
        np.cumsum(items * powers(factor, len(items)) if len(items) else items, out=self.sums[1:])
        self.back = powers(inverse(factor), len(items) + 1)

    def span(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return mix((self.sums[b] - self.sums[a]) * self.back[a])


class Words:
    """The words of several texts in a row.

    ``start`` and ``end`` are byte places in ``data``; the words of text t have the numbers
    ``first[t]`` to ``first[t + 1] - 1``; ``hash`` has one value for each word. ``apart`` marks the bytes
    that stand between words.
    """

    def __init__(self, data: np.ndarray, offsets: np.ndarray, lower: bool = False, apart: np.ndarray = SPACE):
        self.data, self.offsets = data, offsets
        inside = ~apart[data]
        begins, ends = inside.copy(), inside.copy()
        begins[1:] &= ~inside[:-1]
        ends[:-1] &= ~inside[1:]
        filled = offsets[:-1] < offsets[1:]
        heads, tails = offsets[:-1][filled], offsets[1:][filled] - 1
        begins[heads], ends[tails] = inside[heads], inside[tails]
        self.start = np.flatnonzero(begins)
        self.end = np.flatnonzero(ends) + 1
        self.first = np.searchsorted(self.start, offsets)
        self.count = np.diff(self.first)
        letters = Prefix(_BYTE[LOWER[data] if lower else data], _BYTE_FACTOR)
        self.hash = letters.span(self.start, self.end)

    def text_of(self) -> np.ndarray:
        """The number of the text of each word."""
        return np.repeat(np.arange(len(self.count)), self.count)

    def word(self, i: int) -> bytes:
        return self.data[self.start[i] : self.end[i]].tobytes()


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column without nulls."""
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    _, places, data = column.buffers()
    if not len(column) or data is None:
        return np.zeros(0, dtype=np.uint8), np.zeros(len(column) + 1, dtype=np.int64)
    offsets = np.frombuffer(places, dtype=kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    return np.frombuffer(data, dtype=np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


def pieces(batches: Iterator[pa.RecordBatch], text: str, most: int = 1_500_000) -> Iterator[pa.RecordBatch]:
    """Slices of the batches with about ``most`` bytes of text each; a longer single text is a slice of its own."""
    for batch in batches:
        _, offsets = text_buffer(batch.column(text))
        at = 0
        while at < len(batch):
            to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most, side="right")) - 1)
            yield batch.slice(at, to - at)
            at = to


def window_minimum(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` neighbours."""
    reach, found = 1, values
    while reach * 2 <= width:
        found = np.minimum(found[:-reach], found[reach:])
        reach *= 2
    rest = width - reach
    return np.minimum(found[: len(found) - rest], found[rest:]) if rest else found
