"""Whole texts of an Arrow batch as arrays: bytes, words, word hashes and shingle sets.

A batch is handled in slices of a few megabytes, so memory is bounded by the slice and the longest
text, never by the partition. Null texts count as empty.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

SLICE_BYTES = 2 << 20
_MASK = np.uint64(0xFFFFFFFF)


def _odd(seed: int, n: int) -> np.ndarray:
    return np.random.default_rng(seed).integers(1, 1 << 63, n, dtype=np.uint64) | np.uint64(1)


LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

#: Bytes of [^\x00-\x2F\x3A-\x60\x7B-\x7F] after lower-casing: digits, letters, all beyond ASCII.
ALNUM = np.zeros(256, bool)
ALNUM[48:58] = ALNUM[97:123] = ALNUM[65:91] = ALNUM[128:] = True

#: Bytes of [^\x20\x09-\x0D].
SOLID = np.ones(256, bool)
SOLID[[32, *range(9, 14)]] = False


@dataclass
class Texts:
    """Bytes of several texts and the n + 1 offsets at which they begin and end."""

    data: np.ndarray
    offsets: np.ndarray

    def __len__(self) -> int:
        return len(self.offsets) - 1

    def raw(self, i: int) -> bytes:
        return self.data[self.offsets[i] : self.offsets[i + 1]].tobytes()


def texts(column: pa.Array) -> Texts:
    column = column.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    held = column.buffers()[2]
    data = np.frombuffer(held, np.uint8) if held is not None and held.size else np.empty(0, np.uint8)
    return Texts(data[offsets[0] : offsets[-1]], offsets - offsets[0])


def latin_folded(t: Texts) -> Texts:
    """Capitals of the Latin-1 block (in UTF-8: C3 80 to C3 9E, without C3 97) in lower case."""
    lead = np.flatnonzero(t.data[:-1] == 0xC3) if len(t.data) else np.empty(0, np.int64)
    if not len(lead):
        return t
    after = t.data[lead + 1]
    capital = lead[(after >= 0x80) & (after <= 0x9E) & (after != 0x97)] + 1
    if not len(capital):
        return t
    data = t.data.copy()
    data[capital] += 32
    return Texts(data, t.offsets)


def release() -> None:
    """Gives freed memory back; a worker is used again and would keep the most it ever held."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):
        pass  # not glibc


def _bounds(column: pa.Array) -> np.ndarray:
    """The n + 1 offsets of a string column's values, read where they lie."""
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    return np.frombuffer(column.buffers()[1], kind)[column.offset : column.offset + len(column) + 1]


def slices(batches: Iterator[pa.RecordBatch], column: str, most: int = SLICE_BYTES) -> Iterator[tuple[pa.RecordBatch, Texts]]:
    """Row ranges of the batches that hold about ``most`` bytes of text each, one row at least. Only
    the range at hand is copied, never a batch."""
    for batch in batches:
        if not batch.num_rows:
            continue
        held = batch.column(column)
        bounds, at = _bounds(held), 0
        while at < batch.num_rows:
            to = int(np.searchsorted(bounds, int(bounds[at]) + most, "right")) - 1
            to = min(max(to, at + 1), batch.num_rows)
            yield batch.slice(at, to - at), texts(held.slice(at, to - at))
            at = to
    release()


@dataclass
class Words:
    """Starts and ends of words in the data; word ``first[i]`` is the first one of text i."""

    start: np.ndarray
    end: np.ndarray
    first: np.ndarray

    def __len__(self) -> int:
        return len(self.start)

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def text_of(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), self.counts)


def words(t: Texts, inside: np.ndarray) -> Words:
    """Longest runs of bytes that ``inside`` marks; no run crosses from one text to the next."""
    n = len(t.data)
    if not n:
        none = np.empty(0, np.int64)
        return Words(none, none, np.zeros(len(t.offsets), np.int64))
    marked = inside[t.data]
    begins = marked.copy()
    begins[1:] &= ~marked[:-1]
    ends = marked.copy()
    ends[:-1] &= ~marked[1:]
    edges = t.offsets[(t.offsets > 0) & (t.offsets < n)]
    begins[edges] = marked[edges]
    ends[edges - 1] = marked[edges - 1]
    start = np.flatnonzero(begins)
    return Words(start, np.flatnonzero(ends) + 1, np.searchsorted(start, t.offsets))


class Hasher:
    """64-bit polynomial hashes of byte ranges from prefix sums, the same in every process."""

    def __init__(self, seed: int = 1, fold: np.ndarray | None = None) -> None:
        self.table = _odd(seed, 256)
        if fold is not None:
            self.table = self.table[fold]
        base = (int(_odd(seed + 1000, 1)[0]) & ~3) | 3
        self.base, self.inverse = base, pow(base, -1, 1 << 64)
        self.powers = self.inverses = np.empty(0, np.uint64)

    def _room(self, n: int) -> None:
        if len(self.powers) < n:
            up = lambda b: np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(n - 1, b, np.uint64))])
            self.powers, self.inverses = up(self.base), up(self.inverse)

    def of(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        n = len(data)
        self._room(n + 1)
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(self.table[data] * self.powers[:n], out=sums[1:])
        return mixed((sums[end] - sums[start]) * self.inverses[start] + (end - start).astype(np.uint64))


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


_STEP = _odd(77, 64)


def rolled(hashes: np.ndarray, size: int) -> np.ndarray:
    """Hash of ``size`` hashes in a row at each place that has them."""
    out = np.zeros(max(0, len(hashes) - size + 1), np.uint64)
    for k in range(size):
        out += hashes[k : k + len(out)] * _STEP[k]
    return mixed(out)


def shingles(hashes: np.ndarray, first: np.ndarray, size: int) -> list[np.ndarray]:
    """For each text the sorted distinct hashes of ``size`` words in a row; of all its words if it
    has fewer; nothing for a text without words."""
    grams = rolled(hashes, size)
    found = []
    for lo, hi in zip(first[:-1].tolist(), first[1:].tolist()):
        if hi - lo >= size:
            one = np.sort(grams[lo : hi - size + 1])
            found.append(one[np.concatenate([[True], one[1:] != one[:-1]])])
        elif hi > lo:
            short = (hashes[lo:hi] * _STEP[: hi - lo]).sum(dtype=np.uint64) + np.uint64(hi - lo)
            found.append(mixed(np.array([short], np.uint64)))
        else:
            found.append(np.empty(0, np.uint64))
    return found
