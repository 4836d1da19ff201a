"""Words of whole texts as numpy arrays over the UTF-8 bytes of an Arrow batch.

Nothing here loops over characters: a batch of texts is one byte buffer, words are
runs of bytes of a class, and a word's hash comes from prefix sums over the buffer.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_RNG = np.random.default_rng(20240817)
_BYTE = _RNG.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15
_BASE_INVERSE = pow(_BASE, -1, 2**64)
_POWERS: dict[int, np.ndarray] = {}

try:
    _TRIM = ctypes.CDLL(None).malloc_trim
except (AttributeError, OSError):  # another C library
    _TRIM = None

#: Bytes that are no white space: space and U+0009 to U+000D divide words.
NOT_SPACE = np.ones(256, dtype=bool)
NOT_SPACE[[0x20, 9, 10, 11, 12, 13]] = False
#: Bytes of letters, digits and everything beyond ASCII.
ALNUM = np.zeros(256, dtype=bool)
ALNUM[0x30:0x3A] = ALNUM[0x41:0x5B] = ALNUM[0x61:0x7B] = True
ALNUM[0x80:] = True
#: A-Z to a-z, all else unchanged.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32


#: What gives up memory that a worker holds from other work, when word arrays are made.
HELD: list[Callable[[], None]] = []


def _powers(base: int, n: int) -> np.ndarray:
    have = _POWERS.get(base)
    if have is None or len(have) < n:
        size = 1 << max(18, (n - 1).bit_length())
        steps = np.full(size, base, dtype=np.uint64)
        steps[0] = 1
        have = _POWERS[base] = np.multiply.accumulate(steps)
    return have


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads all bits."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def byte_sums(data: np.ndarray) -> np.ndarray:
    """The prefix sums that span hashes are differences of."""
    sums = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum(_BYTE[data] * _powers(_BASE, len(data))[: len(data)], out=sums[1:])
    return sums


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, sums: np.ndarray | None = None) -> np.ndarray:
    """64-bit hash of each data[start:end]; empty spans hash to mix(0)."""
    n = len(data)
    if not n or not len(starts):
        return mix(np.zeros(len(starts), dtype=np.uint64))
    sums = byte_sums(data) if sums is None else sums
    starts, ends = starts.astype(np.int64), ends.astype(np.int64)
    inverse = _powers(_BASE_INVERSE, n)
    return mix((sums[ends] - sums[starts]) * inverse[np.minimum(starts, n - 1)])


@dataclass
class Texts:
    """Texts of a batch: text i is data[offsets[i]:offsets[i + 1]]."""

    data: np.ndarray
    offsets: np.ndarray

    @classmethod
    def of(cls, column: pa.Array) -> "Texts":
        while HELD:
            HELD.pop()()
        if isinstance(column, pa.ChunkedArray):
            column = column.combine_chunks()
        column = column.cast(pa.large_string()).fill_null("")
        if not len(column):
            return cls(np.zeros(0, np.uint8), np.zeros(1, np.int64))
        _, offsets, data = column.buffers()
        at = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
        raw = np.frombuffer(data, dtype=np.uint8)[at[0] : at[-1]] if data else np.zeros(0, np.uint8)
        return cls(raw, at - at[0])

    def __len__(self) -> int:
        return len(self.offsets) - 1

    def lowered(self) -> "Texts":
        return Texts(LOWER[self.data], self.offsets)

    def runs(self, member: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts and ends of the longest runs of member bytes, and the first run of each text."""
        if not len(self.data):
            none = np.zeros(0, np.int64)
            return none, none, np.zeros(len(self) + 1, np.int64)
        inside = member[self.data]
        edges = self.offsets[:-1][self.offsets[:-1] < self.offsets[1:]]
        before = np.empty_like(inside)
        before[0], before[1:] = False, inside[:-1]
        before[edges] = False
        starts = np.flatnonzero(inside & ~before)
        after = np.empty_like(inside)
        after[-1], after[:-1] = False, inside[1:]
        lasts = self.offsets[1:][self.offsets[:-1] < self.offsets[1:]] - 1
        after[lasts] = False
        ends = np.flatnonzero(inside & ~after) + 1
        return starts, ends, np.searchsorted(starts, self.offsets).astype(np.int64)


def windows(hashes: np.ndarray, first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each k consecutive words within a text, and the first window of each text."""
    counts = np.maximum(np.diff(first) - (k - 1), 0)
    bounds = np.concatenate([[0], np.cumsum(counts)]).astype(np.int64)
    if not bounds[-1]:
        return np.zeros(0, np.uint64), bounds
    at = np.repeat(first[:-1] - bounds[:-1], counts) + np.arange(bounds[-1])
    out = np.zeros(len(at), dtype=np.uint64)
    for j in range(k):
        out *= np.uint64(_BASE)
        out += hashes[at + j]
    return mix(out), bounds


def slices(batches: Iterator[pa.RecordBatch], column: str, most_bytes: int = 600_000) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about that many bytes of text; a longer text is alone."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        group = np.cumsum(sizes) // most_bytes
        cuts = np.concatenate([[0], np.flatnonzero(np.diff(group)) + 1, [len(sizes)]])
        for a, b in zip(cuts[:-1], cuts[1:]):
            yield batch.slice(int(a), int(b - a))
    give_back()


def give_back() -> None:
    """Returns freed memory to the system: Python workers outlive the task, and share the executor's memory."""
    pa.default_memory_pool().release_unused()
    if _TRIM:
        _TRIM(0)
