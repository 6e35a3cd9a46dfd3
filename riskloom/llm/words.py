"""Words of whole texts and their hashes, a column of texts at a time, in numpy.

Words are the runs of bytes other than [\\x20\\x09-\\x0D] in UTF-8. A word's hash is a polynomial over table values of
its bytes, mixed; hashes of several words in a row are polynomials over those. All arithmetic is modulo 2**64.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa

from riskloom.llm.common import SPACES

SOLID = np.ones(256, dtype=bool)
SOLID[list(SPACES)] = False
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32
#: Positions in a word whose factors differ; longer words take them round again.
_CYCLE = 1 << 16
#: Bytes of text, and words, worked on at a time; a longer text is one chunk of its own.
_CHUNK, _WORDS = 1 << 20, 1 << 16


def _odd(seed: int, n: int) -> np.ndarray:
    return np.random.default_rng(seed).integers(0, 2**63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads each bit over all."""
    h = h ^ (h >> np.uint64(30))
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


class Hashing:
    """Tables of one seed."""

    def __init__(self, seed: int):
        self.values = _odd(seed, 256)
        self.base = int(_odd(seed + 1, 1)[0])
        step = np.full(_CYCLE, int(_odd(seed + 2, 1)[0]), dtype=np.uint64)
        step[0] = 1
        self.powers = np.multiply.accumulate(step)

    def words(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        out = np.empty(len(starts), dtype=np.uint64)
        for a in range(0, len(starts), _WORDS):
            s, e = starts[a : a + _WORDS], ends[a : a + _WORDS]
            sizes = e - s
            first = np.cumsum(sizes) - sizes
            place = np.arange(int(sizes.sum())) - np.repeat(first, sizes)
            terms = self.values[data[place + np.repeat(s, sizes)]] * self.powers[place & (_CYCLE - 1)]
            out[a : a + _WORDS] = np.add.reduceat(terms, first) + sizes.astype(np.uint64)
        return mixed(out)

    def rows(self, h: np.ndarray, k: int, salt: int = 0) -> np.ndarray:
        """Hashes of each k numbers in a row, by doubling; len(h) - k + 1 of them."""
        n = len(h) - k + 1
        if n <= 0:
            return np.empty(0, dtype=np.uint64)
        base = (self.base + 2 * salt) % 2**64
        part, size, out, done = h, 1, None, 0
        while True:
            if k & size:
                out = part[:n].copy() if out is None else out * np.uint64(pow(base, size, 2**64)) + part[done : done + n]
                done += size
            if size * 2 > k:
                return mixed(out)
            part = part[:-size] * np.uint64(pow(base, size, 2**64)) + part[size:]
            size *= 2


class Chunk(NamedTuple):
    rows: range  # of the column
    data: np.ndarray  # bytes of these texts, one after the other
    starts: np.ndarray  # of each word in data
    ends: np.ndarray
    first: np.ndarray  # index of each row's first word, and their number
    bounds: np.ndarray  # place in data of each row's first byte, and their number


def chunks(column: pa.Array, lower: bool = False, most: int = _CHUNK) -> Iterator[Chunk]:
    """The words of a column of texts, some texts of `most` bytes in all at a time; a null text has none."""
    column = column.cast(pa.large_string())
    n = len(column)
    if not n:
        return
    bounds = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + n + 1]
    all_data = np.frombuffer(column.buffers()[2] or b"", dtype=np.uint8)
    i = 0
    while i < n:
        j = min(n, max(i + 1, int(np.searchsorted(bounds, bounds[i] + most, side="right")) - 1))
        data, at = all_data[bounds[i] : bounds[j]], bounds[i : j + 1] - bounds[i]
        if lower:
            data = LOWER[data]
        solid = SOLID[data]
        starts, ends = solid.copy(), solid.copy()
        starts[1:] &= ~solid[:-1]
        ends[:-1] &= ~solid[1:]
        own = at[:-1][at[:-1] < at[1:]]  # where texts that aren't empty begin
        starts[own] = solid[own]
        ends[own[1:] - 1] = solid[own[1:] - 1]
        starts, ends = np.flatnonzero(starts), np.flatnonzero(ends) + 1
        yield Chunk(range(i, j), data, starts, ends, np.searchsorted(starts, at), at)
        i = j
