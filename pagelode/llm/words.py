"""Words of whole texts as arrays, for the operators that work on Arrow batches inside tasks.

A batch is cut into pieces of a few megabytes of text (a longer text is a piece of its own), so a
task's memory follows the longest text and not the number of rows that Spark puts into a batch.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

PIECE_BYTES = 3 << 20

_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def byte_table(separators: bytes) -> np.ndarray:
    """What each byte of a text becomes: capital A-Z in lower case, separators a blank."""
    table = np.arange(256, dtype=np.uint8)
    table[65:91] += 32
    table[list(separators)] = 32
    return table


#: Words are runs of anything but ASCII white space.
SPACED = byte_table(bytes([32, *range(9, 14)]))
#: Words are runs of ASCII letters, digits and anything beyond ASCII.
ALPHANUMERIC = byte_table(bytes([*range(0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]))


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every bit of the result depends on every bit of the value."""
    x = x.astype(np.uint64)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def text_array(column: pa.Array | pa.ChunkedArray) -> pa.Array:
    """A text column as one array with null as the empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return pc.fill_null(column.cast(pa.large_string()), "")


def pieces(batches: Iterator[pa.RecordBatch], column: str = "text",
           size: int = PIECE_BYTES) -> Iterator[pa.RecordBatch]:
    """The rows of all batches in order, in batches of about ``size`` bytes of text."""
    for batch in batches:
        lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        ends = np.cumsum(lengths, dtype=np.int64)
        start = 0
        while start < batch.num_rows:
            base = ends[start - 1] if start else 0
            end = max(start + 1, int(np.searchsorted(ends, base + size, side="right")))
            yield batch.slice(start, end - start)
            start = end


@dataclass
class Words:
    """The words of the texts of one piece, in order."""

    data: np.ndarray      # all bytes after the byte table, with a blank at either end
    starts: np.ndarray    # first byte of each word
    ends: np.ndarray      # byte after its last one
    doc: np.ndarray       # index of its text in the piece
    counts: np.ndarray    # words of each text
    offsets: np.ndarray   # first word of each text, and the number of words
    hashes: np.ndarray    # 64-bit hash of each word
    breaks: np.ndarray    # where the texts have line feeds
    bounds: np.ndarray    # where each text begins, and the end

    def text(self, i: int) -> str:
        return self.data[self.starts[i]:self.ends[i]].tobytes().decode()


_POWERS: list[np.ndarray] = []


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the multiplier and of its inverse modulo 2^64; kept for the next piece."""
    if not _POWERS or len(_POWERS[0]) < n:
        size = max(n, PIECE_BYTES + (1 << 16))
        made = []
        for base in (_MULTIPLIER, _INVERSE):
            p = np.full(size, base, dtype=np.uint64)
            p[0] = 1
            made.append(np.multiply.accumulate(p))
        if n > 4 * PIECE_BYTES:
            return made[0], made[1]
        _POWERS[:] = made
    return _POWERS[0], _POWERS[1]


_BYTE_VALUES = mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1B54A32D192ED03))


def split_words(texts: pa.Array, table: np.ndarray) -> Words:
    """Words, with a polynomial hash of each taken from one running sum over all bytes."""
    texts = text_array(texts)
    n = len(texts)
    bounds = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset:texts.offset + n + 1]
    if n == 0 or bounds[-1] == bounds[0]:
        empty = np.zeros(0, np.int64)
        return Words(np.zeros(0, np.uint8), empty, empty, empty, np.zeros(n, np.int64), np.zeros(n + 1, np.int64),
                     np.zeros(0, np.uint64), empty, np.zeros(n + 1, np.int64))
    raw = np.frombuffer(texts.buffers()[2], dtype=np.uint8)[bounds[0]:bounds[-1]]
    data = np.full(len(raw) + n + 1, 32, dtype=np.uint8)
    # One blank before each text keeps words of neighbours apart.
    lengths = np.diff(bounds)
    places = np.arange(len(raw)) + np.repeat(np.arange(1, n + 1), lengths)
    data[places] = table[raw]
    inside = data != 32
    edges = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    starts, ends = edges[0::2], edges[1::2]
    text_ends = np.cumsum(lengths) + np.arange(1, n + 1)
    offsets = np.concatenate(([0], np.searchsorted(starts, text_ends)))
    counts = np.diff(offsets)
    powers, inverse = _powers(len(data))
    sums = np.cumsum(_BYTE_VALUES[data] * powers[:len(data)])
    hashes = mixed((sums[ends - 1] - sums[starts - 1]) * inverse[starts])
    return Words(data, starts, ends, np.repeat(np.arange(n), counts), counts, offsets, hashes, places[raw == 10],
                 np.concatenate(([0], text_ends)))


def shingle_hashes(words: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each text's runs of ``size`` words, and where each text's begin.

    A text with fewer words, but some, has one: that of all its words.
    """
    counts = words.counts
    n = np.where(counts >= size, counts - size + 1, np.minimum(counts, 1))
    offsets = np.concatenate(([0], np.cumsum(n)))
    out = np.zeros(offsets[-1], np.uint64)
    if not len(out):
        return out, offsets
    total = len(words.hashes)
    padded = np.concatenate((words.hashes, np.zeros(size, np.uint64)))
    rolled = np.full(total, size, np.uint64)
    for k in range(size):
        rolled = mixed(rolled * _MULTIPLIER + padded[k:k + total])
    first = words.offsets[:-1]
    at = np.arange(len(out)) - np.repeat(offsets[:-1], n) + np.repeat(first, n)
    out[:] = rolled[at]
    for i in np.flatnonzero((counts > 0) & (counts < size)):
        h = np.full(1, counts[i], np.uint64)
        for k in range(first[i], first[i] + counts[i]):
            h = mixed(h * _MULTIPLIER + padded[k:k + 1])
        out[offsets[i]] = h[0]
    return out, offsets
