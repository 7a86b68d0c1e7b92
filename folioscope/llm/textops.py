"""Vectorised text primitives that work on the buffers of Arrow string columns.

A *slice* is a run of consecutive documents of one Arrow batch, at most ``SLICE_BYTES`` long (a longer
document is a slice of its own).  Words are maximal runs of bytes other than space and TAB..CR.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 4 << 20
_CHUNK = 1 << 18
_MASK = (1 << 64) - 1
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_WINDOW_BASE = 0xD6E8FEB86659FD93
_WINDOW_INVERSE = pow(_WINDOW_BASE, -1, 1 << 64)

IS_SPACE = np.zeros(256, dtype=bool)
IS_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
#: One random 64-bit value for each byte value.
_BYTE_VALUE = np.random.Generator(np.random.PCG64(42)).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


_POWERS, _INVERSES = _powers(_BASE, _CHUNK), _powers(_INVERSE, _CHUNK)
_WINDOW_POWERS, _WINDOW_INVERSES = _powers(_WINDOW_BASE, _CHUNK), _powers(_WINDOW_INVERSE, _CHUNK)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers under which near values come apart (the finaliser of SplitMix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@dataclass
class Slice:
    """``offsets`` bounds documents ``first`` .. ``first + n`` of the batch within ``data``."""

    first: int
    data: np.ndarray
    offsets: np.ndarray

    @property
    def n(self) -> int:
        return len(self.offsets) - 1


def string_column(column: pa.Array | pa.ChunkedArray) -> pa.Array:
    """As one non-null large_string array."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return pc.fill_null(column.cast(pa.large_string()), "")


def slices(column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[Slice]:
    column = string_column(column)
    if not len(column):
        return
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    first = 0
    while first < len(column):
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + limit, "right")) - 1)
        last = min(last, len(column))
        yield Slice(first, data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first])
        first = last


def words(part: Slice) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte starts and ends of all words of a slice, and for each document the number of its first word."""
    inside = ~IS_SPACE[part.data]
    begins = np.zeros(len(inside) + 1, dtype=bool)
    begins[part.offsets] = True
    before = np.empty_like(inside)
    before[:1] = False
    before[1:] = inside[:-1]
    starts = np.flatnonzero(inside & (~before | begins[:-1]))
    after = np.empty_like(inside)
    after[-1:] = False
    after[:-1] = inside[1:]
    ends = np.flatnonzero(inside & (~after | begins[1:])) + 1
    return starts, ends, np.searchsorted(starts, part.offsets)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word's bytes: differences of polynomial prefix sums, then mixed."""
    at_start, at_end = np.empty(len(starts), np.uint64), np.empty(len(starts), np.uint64)
    shift = np.empty(len(starts), np.uint64)
    carry, scale, back = 0, 1, 1
    for a in range(0, len(data), _CHUNK):
        b = min(a + _CHUNK, len(data))
        sums = np.empty(b - a + 1, np.uint64)
        sums[0] = carry
        np.cumsum(_BYTE_VALUE[data[a:b]] * (_POWERS[: b - a] * np.uint64(scale)), out=sums[1:])
        sums[1:] += np.uint64(carry)
        i, j = np.searchsorted(starts, (a, b))
        at_start[i:j] = sums[starts[i:j] - a]
        shift[i:j] = _INVERSES[starts[i:j] - a] * np.uint64(back)
        i, j = np.searchsorted(ends, (a + 1, b + 1))
        at_end[i:j] = sums[ends[i:j] - a]
        carry = int(sums[-1])
        scale = scale * pow(_BASE, b - a, 1 << 64) & _MASK
        back = back * pow(_INVERSE, b - a, 1 << 64) & _MASK
    return mix((at_end - at_start) * shift + (ends - starts).astype(np.uint64))


def window_hashes(hashes: np.ndarray, width: int) -> np.ndarray:
    """A 64-bit hash of each ``width`` consecutive words; windows may run over document ends."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out, size = np.empty(n, np.uint64), max(_CHUNK, 2 * width)
    powers, inverses = (_WINDOW_POWERS, _WINDOW_INVERSES) if size == _CHUNK else (_powers(_WINDOW_BASE, size), _powers(_WINDOW_INVERSE, size))
    for a in range(0, n, size - width):
        b = min(a + size - width, n)
        sums = np.zeros(b - a + width, np.uint64)
        np.cumsum(hashes[a : b + width - 1] * powers[: b - a + width - 1], out=sums[1:])
        out[a:b] = (sums[width:] - sums[:-width]) * inverses[: b - a]
    return mix(out)


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """The smallest of each ``width`` consecutive values."""
    out, reach = values, 1
    while reach < width:
        step = min(reach, width - reach)
        out = np.minimum(out[: len(out) - step], out[step:])
        reach += step
    return out


def window_documents(first_word: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """For each window that lies within one document: the number of its first word and its document."""
    counts = np.diff(first_word)
    n = np.maximum(counts - width + 1, 0)
    document = np.repeat(np.arange(len(counts)), n)
    start = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first_word[:-1], n)
    return start, document


def covered(starts: np.ndarray, width: int, n_words: int) -> np.ndarray:
    """Which of ``n_words`` words lie in a window of ``width`` words from one of ``starts``."""
    edges = np.bincount(starts, minlength=n_words + 1) - np.bincount(np.minimum(starts + width, n_words), minlength=n_words + 1)
    return np.cumsum(edges[:-1]) > 0
