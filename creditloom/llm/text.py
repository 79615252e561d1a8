"""Texts of an Arrow batch as bytes: word spans, 64-bit hashes of spans and of word windows, all in numpy.

Word classes are sets of bytes. Every byte of a non-ASCII character is 0x80 or more, so classes that treat
all non-ASCII characters alike are exact on UTF-8 bytes.
"""

from __future__ import annotations

import ctypes
import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 1 << 20
_ROUNDS = 32  # spans of up to 256 bytes are hashed eight bytes at a time, longer ones by blake2b
_M1, _M2, _M3 = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB))


def byte_class(pattern_excluded: bytes) -> np.ndarray:
    """Table of 256 booleans: true for bytes that belong to words."""
    table = np.ones(256, bool)
    table[list(pattern_excluded)] = False
    return table


#: Words are runs of anything but space and 0x09-0x0D.
SPACED = byte_class(b" \t\n\x0b\x0c\r")
#: Words are runs of digits, a-z and non-ASCII characters (upper case is lowered first).
ALNUM = byte_class(bytes(range(0x00, 0x30)) + bytes(range(0x3A, 0x61)) + bytes(range(0x7B, 0x80)))
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def tidy(run: Callable) -> Callable:
    """``run`` over batches, after which the worker gives freed memory back to the system.

    Workers stay for later tasks and stages; without this each keeps the most that any of its tasks ever needed.
    """

    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        try:
            ctypes.CDLL(None).malloc_trim(0)
        except (AttributeError, OSError):  # not every C library has it
            pass

    return wrapped


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * _M2
    h = (h ^ (h >> np.uint64(27))) * _M3
    return h ^ (h >> np.uint64(31))


def slices(batch: pa.RecordBatch, column: str, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Pieces of a batch that hold about ``most`` bytes of text; a longer text is a piece of its own."""
    if not batch.num_rows:
        return
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    group = (np.cumsum(sizes, dtype=np.int64) - sizes) // most
    cuts = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), batch.num_rows]
    for a, b in zip(cuts, cuts[1:]):
        yield batch.slice(a, b - a)


class Texts:
    """Bytes of a string column (null: empty) and where each text begins and ends."""

    def __init__(self, column: pa.Array, lower: bool = False):
        column = pc.fill_null(column, "").cast(pa.large_string())
        _, offsets, data = column.buffers()
        at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
        raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.empty(0, np.uint8)
        # eight spare bytes let every position be read as a 64-bit number
        self.bytes = np.zeros(len(raw) + 8, np.uint8)
        self.bytes[: len(raw)] = LOWER[raw] if lower else raw
        self.n = len(raw)
        self.at = at - at[0]

    def runs(self, member: np.ndarray) -> Spans:
        """Maximal runs of member bytes; none crosses from one text to the next."""
        inside = member[self.bytes[: self.n]]
        edge = np.zeros(self.n + 1, bool)
        edge[self.at] = True
        first, last = inside.copy(), inside.copy()
        first[1:] &= ~inside[:-1] | edge[1:-1]
        last[:-1] &= ~inside[1:] | edge[1:-1]
        return Spans(self, np.flatnonzero(first), np.flatnonzero(last) + 1)

    def lines(self) -> Spans:
        """The pieces between newlines; an empty text has one empty line."""
        breaks = np.flatnonzero(self.bytes[: self.n] == 10)
        starts = np.concatenate([self.at[:-1], breaks + 1])
        ends = np.concatenate([self.at[1:], breaks])
        # a text's first line and the line after its last break share a place when the text is empty
        owner = np.concatenate([np.arange(len(self.at) - 1), np.searchsorted(self.at, breaks, "right") - 1])
        start_order = np.lexsort((starts, owner))
        end_order = np.lexsort((ends, owner))
        return Spans(self, starts[start_order], ends[end_order], owner[start_order])


class Spans:
    """Byte ranges in text order, with the text each belongs to."""

    def __init__(self, texts: Texts, start: np.ndarray, end: np.ndarray, owner: np.ndarray | None = None):
        self.texts, self.start, self.end = texts, start, end
        docs = len(texts.at) - 1
        if owner is None:
            self.bounds = np.searchsorted(start, texts.at)
            self.bounds[-1] = len(start)
        else:
            self.bounds = np.searchsorted(owner, np.arange(docs + 1))
        self.count = np.diff(self.bounds)
        self.owner = np.repeat(np.arange(docs), self.count)

    def __len__(self) -> int:
        return len(self.start)

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each span's bytes."""
        length = self.end - self.start
        h = (length.astype(np.uint64) + np.uint64(1)) * _M1
        data = self.texts.bytes
        if not len(self) or len(data) < 9:
            return mix(h)
        eight = np.ndarray((len(data) - 7,), "<u8", data, 0, (1,))
        short = length <= 8 * _ROUNDS
        todo = np.flatnonzero(short & (length > 0))
        for k in range(_ROUNDS):
            if not len(todo):
                break
            left = length[todo] - 8 * k
            part = eight[self.start[todo] + 8 * k]
            tail = left < 8
            part = np.where(tail, part & ((np.uint64(1) << (np.uint64(8) * np.minimum(left, 7).astype(np.uint64))) - np.uint64(1)), part)
            x = (h[todo] ^ part) * _M2
            h[todo] = x ^ (x >> np.uint64(32))
            todo = todo[left > 8]
        view = memoryview(data)
        for i in np.flatnonzero(~short):
            digest = hashlib.blake2b(view[self.start[i] : self.end[i]], digest_size=8).digest()
            h[i] ^= np.uint64(int.from_bytes(digest, "little"))
        return mix(h)

    def windows(self, h: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
        """Hash of each ``size`` consecutive spans of one text, and the index of their first."""
        room = self.bounds[1:][self.owner] - np.arange(len(self))
        first = np.flatnonzero(room >= size)
        return window_hashes(h, size)[first], first

    def string(self, i: int) -> str:
        return bytes(self.texts.bytes[self.start[i] : self.end[i]]).decode("utf-8", "replace")


def window_hashes(h: np.ndarray, size: int) -> np.ndarray:
    """Hash of h[i : i + size] for every i (windows that run over the end are padded with zeros)."""
    done, width = np.zeros(len(h), np.uint64), 0
    power, span, factor = h.copy(), 1, _M1
    while size:
        if size & 1:
            # what is done so far follows the new, longer part
            shifted = np.zeros(len(h), np.uint64)
            shifted[: max(len(h) - span, 0)] = done[span:]
            scale = np.uint64(pow(int(_M1), width, 1 << 64))
            done = power * scale + shifted
            width += span
        size >>= 1
        if size:
            shifted = np.zeros(len(h), np.uint64)
            shifted[: max(len(h) - span, 0)] = power[span:]
            power = power * factor + shifted
            factor = np.uint64(int(factor) * int(factor) % (1 << 64))
            span *= 2
    return mix(done)


def ranges(first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """All integers of [first, first + count) for each pair, one after another."""
    total = int(count.sum())
    if not total:
        return np.empty(0, np.int64)
    skip = np.repeat(first - (np.cumsum(count) - count), count)
    return np.arange(total) + skip


def run_starts(sorted_values: np.ndarray) -> np.ndarray:
    """Where each run of equal values begins."""
    if not len(sorted_values):
        return np.empty(0, np.int64)
    return np.flatnonzero(np.concatenate([[True], sorted_values[1:] != sorted_values[:-1]]))


def binary_array(parts: list[bytes]) -> pa.Array:
    return pa.array(parts, pa.binary())


def signed(h: np.ndarray) -> np.ndarray:
    return h.view(np.int64)
