"""Words of Arrow string columns as byte ranges, found with whole-array operations.

Texts stay in their Arrow buffer.  A chunk of rows gives the byte ranges of its words.
Words are told apart by their bytes: Arrow's dictionary encoding gives each different
word of a chunk a code.  What must hold beyond a chunk is a 128-bit hash of the bytes,
made once for each different word.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

#: Bytes of text handled at once; bounds the memory of a Python worker, whatever the batch holds.
CHUNK_BYTES = 1 << 20

SPACE_BYTES = (0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D)
_U = np.uint64
try:
    _libc = ctypes.CDLL("libc.so.6")
    _libc.malloc_trim  # noqa: B018
except (OSError, AttributeError):  # another C library
    _libc = None


def space_split_table() -> np.ndarray:
    """True for the bytes of words ``[^\\x20\\x09-\\x0D]+``."""
    table = np.ones(256, bool)
    table[list(SPACE_BYTES)] = False
    return table


def alnum_table() -> np.ndarray:
    """True for the bytes of words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` (lower-cased text)."""
    table = np.zeros(256, bool)
    table[0x30:0x3A] = table[0x61:0x7B] = table[0x80:] = True
    return table


def lower_table() -> np.ndarray:
    """Byte to byte; A-Z to a-z."""
    table = np.arange(256, dtype=np.uint8)
    table[0x41:0x5B] += 32
    return table


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser, so that all bits of a hash depend on all bits of its input."""
    h = (h ^ (h >> _U(31))) * _U(0x7FB5D329728EA185)
    h = (h ^ (h >> _U(27))) * _U(0x81DADEF4BC2DD44D)
    return h ^ (h >> _U(33))


def segments(data: np.ndarray, bounds: np.ndarray) -> pa.Array:
    """The bytes between neighbouring bounds, without a copy."""
    wide = len(data) >= 1 << 31
    offsets = np.ascontiguousarray(bounds, np.int64 if wide else np.int32)
    return pa.Array.from_buffers(pa.large_binary() if wide else pa.binary(), len(offsets) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data))])


def give_back() -> None:
    """Returns freed memory of this Python worker, which lives on for other tasks, to the system."""
    pa.default_memory_pool().release_unused()
    if _libc is not None:
        _libc.malloc_trim(0)


def coded(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, pa.Array]:
    """(code of each byte range, the bytes of each code): equal codes are equal bytes."""
    if not len(start):
        return np.zeros(0, np.int64), pa.array([], pa.binary())
    bounds = np.empty(2 * len(start), np.int64)
    bounds[0::2], bounds[1::2] = start, end
    found = segments(data, bounds).dictionary_encode()  # every second one is what lies between two words
    return found.indices.to_numpy(zero_copy_only=False)[::2].astype(np.int64), found.dictionary


def digests(terms: pa.Array) -> np.ndarray:
    """Two independent 64-bit halves of a hash of each term's bytes, as two rows."""
    raw = b"".join(map(xxhash.xxh3_128_digest, terms.to_pylist()))
    return np.frombuffer(raw, ">u8").reshape(-1, 2).T.astype(_U)


class Chunk:
    """Some rows of a text column: ``rows`` of the batch, and the words of each.

    ``first[i]:first[i+1]`` are the words of row i; ``start`` and ``end`` are their
    byte ranges in ``data``.
    """

    def __init__(self, at: int, data: np.ndarray, offsets: np.ndarray, is_word: np.ndarray):
        self.at, self.data, self.offsets = at, data, offsets
        inside = is_word[data].view(np.int8)
        n = len(inside)
        before, after = np.zeros(n, np.int8), np.zeros(n, np.int8)
        if n:
            before[1:], after[:-1] = inside[:-1], inside[1:]
            edges = offsets[:-1][offsets[:-1] < n]
            before[edges] = 0
            after[edges[edges > 0] - 1] = 0
        self.start = np.flatnonzero(inside > before)
        self.end = np.flatnonzero(inside > after) + 1
        self.first = np.searchsorted(self.start, offsets)
        self._coded = self._digests = None

    def __len__(self) -> int:
        return len(self.offsets) - 1

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def row_of_word(self) -> np.ndarray:
        return np.repeat(np.arange(len(self)), self.counts)

    def coded(self) -> tuple[np.ndarray, pa.Array]:
        """(code of each word, the bytes of each code); codes hold in this chunk only."""
        if self._coded is None:
            self._coded = coded(self.data, self.start, self.end)
        return self._coded

    def codes(self) -> np.ndarray:
        return self.coded()[0]

    def hashes(self, half: int = 0) -> np.ndarray:
        """One half of the 128-bit hash of each word's bytes."""
        code, terms = self.coded()
        if self._digests is None:
            self._digests = digests(terms)
        return self._digests[half][code]

    def text(self, i: int) -> bytes:
        return self.data[self.offsets[i] : self.offsets[i + 1]].tobytes()


def string_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row offsets of a string column; null rows are empty."""
    column = pc.fill_null(column, "") if column.null_count else column
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    if not wide and not (pa.types.is_string(column.type) or pa.types.is_binary(column.type)):
        column = column.cast(pa.string())
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def row_groups(offsets: np.ndarray, most: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Runs of rows with about ``most`` bytes, one row at least: a longer text is not cut."""
    at, n = 0, len(offsets) - 1
    while at < n:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most, "right")) - 1)
        yield at, min(to, n)
        at = to


def chunks(column: pa.Array, is_word: np.ndarray, lower: bool = False, most: int = CHUNK_BYTES) -> Iterator[Chunk]:
    data, offsets = string_buffers(column)
    table = lower_table()
    for a, b in row_groups(offsets, most):
        part = data[offsets[a] : offsets[b]]
        yield Chunk(a, table[part] if lower else part, offsets[a : b + 1] - offsets[a], is_word)
        del part
    give_back()


def row_sums(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sums of the values of each row; rows are runs first[i]:first[i+1]."""
    total = np.zeros(len(values) + 1, np.int64)
    np.cumsum(values, out=total[1:])
    return total[first[1:]] - total[first[:-1]]


def spread(mark: np.ndarray, width: int, first: np.ndarray) -> np.ndarray:
    """Marks words covered by a window: mark[i] says that words i..i+width-1 are in one."""
    step = np.zeros(len(mark) + width + 1, np.int32)
    at = np.flatnonzero(mark)
    np.add.at(step, at, 1)
    np.add.at(step, at + width, -1)
    return np.cumsum(step)[: len(mark)] > 0
