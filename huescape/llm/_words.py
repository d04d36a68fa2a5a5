"""Words of UTF-8 text and their hashes, by NumPy over Arrow's buffers: no Python object per word."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20
#: `[^\x20\x09-\x0D]+`
NOT_SPACE = np.ones(256, bool)
NOT_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = False
#: `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+` of text whose A-Z are lower-cased: digits, letters and all beyond ASCII
ALNUM = np.zeros(256, bool)
ALNUM[0x30:0x3A] = ALNUM[0x41:0x5B] = ALNUM[0x61:0x7B] = True
ALNUM[0x80:] = True


def release() -> None:
    """Gives freed memory back to the system. The C library and Arrow keep what arrays leave behind, and a worker lives on
    beside the workers of later stages."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc alone has it
    if trim:
        trim(0)


def lean(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """run as a task that leaves its worker no larger than what the worker keeps on purpose."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            release()

    return task


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits under which similar inputs become unrelated outputs."""
    t = x >> np.uint64(30)
    x = x ^ t
    for factor, shift in ((0xBF58476D1CE4E5B9, 27), (0x94D049BB133111EB, 31)):  # in place: arrays can be those of a long text
        x *= np.uint64(factor)
        t = np.right_shift(x, np.uint64(shift), out=t) if isinstance(t, np.ndarray) else x >> np.uint64(shift)
        x ^= t
    return x


#: Places in a word whose bytes have their numbers in a table; later places have them worked out.
_PLACES = 64
_LANE = np.uint64(0xA0761D6478BD642F)
_tables: list[np.ndarray] = []


def byte_numbers(data: np.ndarray, starts: np.ndarray, lane: int = 0) -> np.ndarray:
    """A pseudorandom number for each byte and its place after the last of `starts` (ascending). Sums of them tell words
    apart whatever their letters' pattern is: unlike powers of a base modulo 2^64, the numbers follow no rule that a
    pattern could cancel. Lane 1 has numbers made from neighbouring bytes, which have no sums in common with lane 0."""
    if not _tables:
        _tables.append(mix(np.arange(1, _PLACES * 256 + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)))
    n = len(data)
    cuts = np.concatenate([[0], starts]).astype(np.int32)
    place = np.arange(n, dtype=np.int32)
    place -= np.repeat(cuts, np.diff(np.append(cuts, n)))
    far = np.flatnonzero(place >= _PLACES)
    later = (place[far].astype(np.uint64) * np.uint64(256) + data[far] + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    np.minimum(place, _PLACES - 1, out=place)
    place <<= 8
    place |= data
    x = _tables[0][place]
    del place
    x[far] = mix(later)
    if lane:
        before = np.zeros(n, np.uint64)
        before[1:] = x[:-1]
        before[starts] = 0
        before *= _LANE
        x ^= before
        del before
        x = mix(x)
    return x


def sums(x: np.ndarray) -> np.ndarray:
    """x's running sums modulo 2^64, from 0 on."""
    total = np.zeros(len(x) + 1, np.uint64)
    np.cumsum(x, out=total[1:])
    return total


def with_length(h: np.ndarray, size: np.ndarray) -> np.ndarray:
    return mix(h + size.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def same_bytes(a: np.ndarray, a_at: np.ndarray, b: np.ndarray, b_at: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Whether the stretches a[a_at : a_at + size] and b[b_at : b_at + size] are equal, each pair by itself."""
    out, ends = np.ones(len(size), bool), np.cumsum(size)
    if len(size) and ends[-1]:
        step = np.arange(ends[-1]) - np.repeat(ends - size, size)
        wrong = a[np.repeat(a_at, size) + step] != b[np.repeat(b_at, size) + step]
        if wrong.any():
            out[np.searchsorted(ends, np.flatnonzero(wrong), side="right")] = False
    return out


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and each row's offsets in them; null counts as empty."""
    column = column.cast(pa.large_string()).fill_null("")
    off = np.frombuffer(column.buffers()[1], np.int64, len(column) + 1, column.offset * 8) if len(column) else np.zeros(1, np.int64)
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data[off[0] : off[-1]], off - off[0]


def pieces(offsets: np.ndarray, most: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Runs of whole rows of about `most` bytes (a longer row stands alone), which bounds the arrays made from them."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, side="right")) - 1)
        yield i, min(j, n)
        i = j


class Words:
    """Words of consecutive rows. starts, ends: bytes of each word in `low`; first: of each row, the index of its first word."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, inside: np.ndarray):
        self.low = LOWER[data]
        mask = inside[data]
        begin, end = mask.copy(), mask.copy()
        if len(data):
            begin[1:] &= ~mask[:-1]
            end[:-1] &= ~mask[1:]
            cut = offsets[(offsets > 0) & (offsets < len(data))]
            begin[cut] = mask[cut]
            end[cut - 1] = mask[cut - 1]
        self.starts, self.ends = np.flatnonzero(begin), np.flatnonzero(end) + 1
        self.first = np.searchsorted(self.starts, offsets)

    def sums(self, lane: int = 0) -> np.ndarray:
        """Running sums of the bytes' numbers: those of a word, or of its beginning, are a difference of two."""
        return sums(byte_numbers(self.low, self.starts, lane))

    def hashes(self, lane: int = 0) -> np.ndarray:
        """64 bits for each word. Two lanes have nothing in common, so both together are 128 bits."""
        total = self.sums(lane)
        return with_length(total[self.ends] - total[self.starts], self.ends - self.starts)

    def word(self, i: int, n: int = 1) -> bytes:
        """n words from the i-th, with one blank between."""
        return b" ".join(self.low[s:e].tobytes() for s, e in zip(self.starts[i : i + n], self.ends[i : i + n], strict=True))
