"""Whole texts as numpy arrays: words, word hashes and shingles of many texts at a time.

Texts are taken in slices of about ``SLICE`` bytes, so a worker's memory stays bounded however
long the Arrow batch is; a single text longer than that is a slice of its own, and stays whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE = 1 << 18
_BASE = 0x9E3779B97F4A7C15 | 1
_MASK = (1 << 64) - 1


def slices(batch: pa.RecordBatch, column: str = "text", most: int = SLICE) -> Iterator[tuple[int, list[str | None]]]:
    """(first row, texts) of consecutive rows; null texts stay None."""
    col = batch.column(column)
    ends = np.cumsum(pc.fill_null(pc.binary_length(col), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at, n = 0, len(col)
    while at < n:
        to = int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, "right"))
        to = min(max(at + 1, to), n)
        yield at, col.slice(at, to - at).to_pylist()
        at = to


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer (public splitmix constants)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@lru_cache(maxsize=1)
def _byte_values() -> np.ndarray:
    return mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93))


_powers: list[np.ndarray] = []


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _powers or len(_powers[0]) < n:
        n = max(n, 2 * SLICE)
        up, down = np.full(n, _BASE, np.uint64), np.full(n, pow(_BASE, -1, 1 << 64), np.uint64)
        up[0] = down[0] = 1
        _powers[:] = [np.cumprod(up), np.cumprod(down)]
    return _powers[0], _powers[1]


SPACES = np.zeros(256, bool)
SPACES[[0x20, 9, 10, 11, 12, 13]] = True
_fold = np.arange(256, dtype=np.uint8)
_fold[65:91] += 32


#: All ASCII but letters and digits.
GAPS = np.zeros(256, bool)
GAPS[:128] = [not chr(c).isalnum() for c in range(128)]


class Words:
    """Words ``[^\\x20\\x09-\\x0D]+`` of texts: byte data, starts, ends and the text each word is of.

    ``gaps`` marks other bytes that end words; the line feed must be one of them."""

    def __init__(self, texts: list[str | None], lower: bool = True, gaps: np.ndarray = SPACES):
        parts = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
        self.n = len(parts)
        self.data = np.frombuffer(b"\n".join(parts) + b"\n", np.uint8)
        if lower:
            self.data = _fold[self.data]
        self.lengths = np.fromiter(map(len, parts), np.int64, self.n)
        self.begin = np.concatenate([[0], np.cumsum(self.lengths + 1)[:-1]]).astype(np.int64)
        space = gaps[self.data]
        edge = np.flatnonzero(np.diff(np.concatenate([[True], space]).astype(np.int8)))
        self.starts, self.ends = edge[::2], edge[1::2]
        self.first = np.searchsorted(self.starts, np.append(self.begin, len(self.data)))  # of each text's words
        self.counts = np.diff(self.first)
        self.doc = np.repeat(np.arange(self.n), self.counts)

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each word; equal words have equal hashes wherever they stand."""
        up, down = powers(len(self.data))
        total = np.concatenate([[np.uint64(0)], np.cumsum(_byte_values()[self.data] * up[: len(self.data)])])
        return mix((total[self.ends] - total[self.starts]) * down[self.starts])


def shingles(hashes: np.ndarray, size: int) -> np.ndarray:
    """Hashes of each run of ``size`` consecutive values; one of all of them where there are fewer, but some."""
    n = len(hashes)
    if not n:
        return hashes
    size = min(size, n)
    out = np.full(n - size + 1, np.uint64(size), np.uint64)
    for k in range(size):
        out = mix(out * np.uint64(_BASE) + hashes[k : n - size + 1 + k])
    return out


def shingle_sets(words: Words, size: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingles of each text."""
    h = words.hashes()
    whole = shingles(h, size) if len(h) >= size else h[:0]  # of all texts at once; those over a border are left out below
    for a, b in zip(words.first[:-1], words.first[1:], strict=True):
        yield np.unique(whole[a : b - size + 1] if b - a >= size else shingles(h[a:b], size))


def per_text(words: Words, flags: np.ndarray) -> np.ndarray:
    """How many bytes of each text are flagged."""
    total = np.concatenate([[0], np.cumsum(flags)])
    return total[words.begin + words.lengths] - total[words.begin]


def columns(**values) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([v if isinstance(v, pa.Array) else pa.array(v) for v in values.values()], list(values))
