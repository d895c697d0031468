"""Word hashing over flat UTF-8 buffers.

Text operators see an Arrow string column as one byte array plus offsets, so a batch of
documents is scanned with numpy instead of building a Python string for every word.  Work is
done on slices of some hundred kilobytes, which bounds the memory of a task whatever the batch holds.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 1 << 18
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_INV = np.uint64(pow(int(_BASE), -1, 1 << 64))
_TABLE = np.random.default_rng(20240229).integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def byte_class(*ranges: tuple[int, int]) -> np.ndarray:
    """A 256-entry mask that is true inside the given inclusive byte ranges."""
    mask = np.zeros(256, bool)
    for lo, hi in ranges:
        mask[lo : hi + 1] = True
    return mask


#: Every byte but tab, line feed, vertical tab, form feed, carriage return and space.
NOT_BLANK = ~byte_class((0x09, 0x0D), (0x20, 0x20))
#: ASCII digits and letters and every byte of a non-ASCII character.
ALNUM = byte_class((0x30, 0x39), (0x41, 0x5A), (0x61, 0x7A), (0x80, 0xFF))
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32


class Docs(NamedTuple):
    """A run of documents: their positions in the batch, all bytes, and n + 1 offsets."""

    first: int
    data: np.ndarray
    offsets: np.ndarray

    def __len__(self) -> int:
        return len(self.offsets) - 1


class Words(NamedTuple):
    """Start and end byte of each word, its hash, and for each document its first word's index."""

    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray
    bounds: np.ndarray

    @property
    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.bounds) - 1), np.diff(self.bounds))


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def text_slices(column: pa.Array, most: int = SLICE_BYTES) -> Iterator[Docs]:
    """Consecutive documents of a string column (null: empty) in slices of about ``most`` bytes.

    A document longer than that makes a slice of its own.
    """
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string())
    if column.null_count:
        column = pc.fill_null(column, "")
    n = len(column)
    if not n:
        return
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + n + 1]
    data = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] is not None else np.zeros(0, np.uint8)
    i = 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, "right")) - 1)
        j = min(j, n)
        yield Docs(i, data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
        i = j


_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the hash base and of its inverse, modulo 2**64."""
    if len(_powers[0]) < n:
        for k, base in enumerate((_BASE, _INV)):
            x = np.full(1 << max(n - 1, 1).bit_length(), base, np.uint64)
            x[0] = 1
            np.multiply.accumulate(x, out=x)
            _powers[k] = x
    return _powers[0][:n], _powers[1][:n]


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """P with P[j] - P[i] = the hash of data[i:j] times base**i, modulo 2**64."""
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_TABLE[data] * powers(len(data) + 1)[0][: len(data)], out=out[1:])
    return out


def words(docs: Docs, inside: np.ndarray, fold: np.ndarray | None = None, parts: np.ndarray | None = None) -> Words:
    """The maximal runs of ``inside`` bytes within each document, hashed after mapping by ``fold``.

    ``parts`` gives bytes a class; a run is also cut between a byte of class 1 and one of class 2.
    """
    data, offsets = docs.data, docs.offsets
    if not len(data):
        empty = np.zeros(0, np.int64)
        return Words(empty, empty, np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64))
    w = inside[data]
    start = w.copy()
    start[1:] &= ~w[:-1]
    end = w.copy()
    end[:-1] &= ~w[1:]
    if parts is not None:
        c = parts[data]
        split = c[1:] * c[:-1] == 2
        start[1:] |= split
        end[:-1] |= split
    cuts = offsets[1:-1]
    cuts = cuts[(cuts > 0) & (cuts < len(data))]
    start[cuts] = w[cuts]
    end[cuts - 1] = w[cuts - 1]
    starts = np.flatnonzero(start)
    ends = np.flatnonzero(end) + 1
    p = prefix_hash(data if fold is None else fold[data])
    h = (p[ends] - p[starts]) * powers(len(data) + 1)[1][starts]
    return Words(starts, ends, mix(h ^ (ends - starts).astype(np.uint64)), np.searchsorted(starts, offsets))


def windows(w: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The hash of the k words from each word on, and whether these lie in one document."""
    n = len(w.hash)
    out = np.zeros(n, np.uint64)
    scale = mix(np.arange(1, k + 1, dtype=np.uint64)) | np.uint64(1)  # unrelated, so that no two orders of words agree
    for j in range(min(k, n)):
        out[: n - j] += w.hash[j:] * scale[j]
    whole = np.arange(n) + k <= np.repeat(w.bounds[1:], np.diff(w.bounds))
    return mix(out), whole
