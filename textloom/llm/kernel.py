"""Vectorised text primitives shared by the Arrow operators.

A word is a maximal run of bytes outside ``\\x20 \\x09-\\x0D``.  All functions
work on slices of an Arrow string column as flat numpy arrays, so the cost per
byte is a handful of array passes and memory is bounded by the slice size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text handled at a time; one longer text makes a slice of its own.
SLICE_BYTES = 1 << 18

U64 = np.uint64
WORD_BREAKS = b" \t\n\x0b\x0c\r"
IS_BREAK = np.zeros(256, bool)
IS_BREAK[list(WORD_BREAKS)] = True


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser: every input bit reaches every output bit."""
    h = h ^ (h >> U64(30))
    h = h * U64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> U64(27))
    h = h * U64(0x94D049BB133111EB)
    return h ^ (h >> U64(31))


class Roller:
    """Hashes of arbitrary ranges of a sequence from one prefix sum mod 2**64."""

    def __init__(self, seed: int):
        base = np.random.default_rng(seed).integers(0, 2**62, dtype=np.int64)
        self.base = (int(base) * 8 + 3) % 2**64
        self.inverse = pow(self.base, -1, 2**64)
        self.up = np.ones(1, U64)
        self.down = np.ones(1, U64)

    def _grow(self, n: int) -> None:
        while len(self.up) < n:
            k = len(self.up)
            self.up = np.concatenate([self.up, self.up * U64(pow(self.base, k, 2**64))])
            self.down = np.concatenate([self.down, self.down * U64(pow(self.inverse, k, 2**64))])

    def prefix(self, codes: np.ndarray) -> np.ndarray:
        n = len(codes)
        self._grow(n + 1)
        out = np.zeros(n + 1, U64)
        np.cumsum(codes * self.up[:n], out=out[1:])
        return out

    def ranges(self, prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((prefix[end] - prefix[start]) * self.down[start])


def byte_codes(seed: int) -> np.ndarray:
    return np.random.default_rng(seed).integers(1, 2**63, 256, dtype=np.int64).astype(U64) * U64(2) + U64(1)


class Texts:
    """Some texts of a batch: their bytes, words and word hashes.

    ``bounds`` are the byte offsets of the texts (one more than there are
    texts), ``start``/``end`` those of the words, ``first`` the index of each
    text's first word (and the number of words at the end).
    """

    def __init__(self, data: np.ndarray, bounds: np.ndarray):
        self.data, self.bounds, self.n = data, bounds, len(bounds) - 1
        size = len(data)
        inside = np.zeros(size + 2, bool)
        inside[1:-1] = ~IS_BREAK[data]
        begins = inside[1:-1] & ~inside[:-2]
        ends = inside[1:-1] & ~inside[2:]
        edges = bounds[(bounds > 0) & (bounds < size)]
        begins[edges] |= inside[edges + 1]
        ends[edges - 1] |= inside[edges]
        self.start = np.flatnonzero(begins)
        self.end = np.flatnonzero(ends) + 1
        self.first = np.searchsorted(self.start, bounds)
        self.counts = np.diff(self.first)

    def owner(self) -> np.ndarray:
        """The text of each word."""
        return np.repeat(np.arange(self.n), self.counts)

    def range_hashes(self, start, end, roller: Roller, codes: np.ndarray) -> np.ndarray:
        return roller.ranges(roller.prefix(codes[self.data]), start, end)

    def word_hashes(self, roller: Roller, codes: np.ndarray) -> np.ndarray:
        return self.range_hashes(self.start, self.end, roller, codes)

    def windows(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """First words of the n-word windows inside one text, and the windows per text."""
        counts = np.maximum(self.counts - n + 1, 0)
        offset = np.repeat(self.first[:-1] - np.cumsum(counts) + counts, counts)
        return np.arange(len(offset)) + offset, counts


def slices(column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, byte bounds) of consecutive rows; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    rows = len(column)
    if not rows:
        return
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, values = column.buffers()
    bounds = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + rows + 1].astype(np.int64)
    data = np.frombuffer(values, np.uint8) if values is not None and values.size else np.zeros(0, np.uint8)
    at = 0
    while at < rows:
        end = max(at + 1, int(np.searchsorted(bounds, bounds[at] + limit, side="right")) - 1)
        yield at, end, data[bounds[at] : bounds[end]], bounds[at : end + 1] - bounds[at]
        at = end


def per_text(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sums of ``values`` between consecutive entries of ``first``."""
    total = np.zeros(len(values) + 1, np.int64)
    np.cumsum(values, out=total[1:])
    return total[first[1:]] - total[first[:-1]]


def in_sorted(values: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Membership of values in a sorted table."""
    if not len(table):
        return np.zeros(len(values), bool)
    at = np.searchsorted(table, values)
    at[at == len(table)] = 0
    return table[at] == values


def repeated(hashes: np.ndarray) -> np.ndarray:
    """Which hashes occur twice or more."""
    order = np.sort(hashes)
    return in_sorted(hashes, np.unique(order[1:][order[1:] == order[:-1]]))


def covered(marks: np.ndarray, width: int, size: int) -> np.ndarray:
    """Positions 0..size-1 within ``width`` of a mark's start."""
    edge = np.zeros(size + 1, np.int32)
    np.add.at(edge, marks, 1)
    np.add.at(edge, np.minimum(marks + width, size), -1)
    return np.cumsum(edge[:-1]) > 0
