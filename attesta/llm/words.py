"""Words of Arrow text columns as numpy arrays: spans, hashes and hashes of word sequences."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SLICE_BYTES = 4 << 20

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_DRAW = np.random.default_rng(20240611)
_BYTE = _DRAW.integers(1, 1 << 63, (2, 256), dtype=np.uint64)
_STEP = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))
_PLACE = _DRAW.integers(1, 1 << 63, (2, 256), dtype=np.uint64) | np.uint64(1)
LOWER_TABLE = _LOWER.tobytes()


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches cut so that each holds about `limit` bytes of `column`, or one longer row."""
    for batch in batches:
        if not batch.num_rows:
            continue
        text = batch.column(column)
        sizes = np.frombuffer(text.buffers()[1], np.int32)[text.offset : text.offset + len(text) + 1].astype(np.int64)
        at = 0
        while at < batch.num_rows:
            end = max(at + 1, int(np.searchsorted(sizes, sizes[at] + limit, "right")) - 1)
            yield batch.slice(at, min(end, batch.num_rows) - at)
            at = end


class Words:
    """The words `[^\\x20\\x09-\\x0D]+` of all rows of a text column.

    `row` is the row of each word, `first` the number of words before each row. Null texts have none.
    """

    def __init__(self, column: pa.Array, lower: bool = False):
        column = column.fill_null("")
        n = len(column)
        at = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
        data = column.buffers()[2]
        self.bytes = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8)
        if lower:
            self.bytes = _LOWER[self.bytes]
        at -= at[0]
        self.solid = ~_SPACE[self.bytes]
        size = len(self.bytes)
        before, after = np.ones(size, bool), np.ones(size, bool)
        before[1:], after[:-1] = ~self.solid[:-1], ~self.solid[1:]
        before[at[:-1][at[:-1] < size]] = True
        after[at[1:][at[1:] > 0] - 1] = True
        self.start = np.flatnonzero(self.solid & before)
        self.end = np.flatnonzero(self.solid & after) + 1
        self.first = np.searchsorted(self.start, at, "left")
        self.count = np.diff(self.first)
        self.row = np.repeat(np.arange(n), self.count)
        self.place = np.arange(len(self.start)) - np.repeat(self.first[:-1], self.count)

    def hashes(self, which: int = 0) -> np.ndarray:
        """A 64-bit hash of each word's bytes; `which` picks one of two independent ones."""
        if not len(self.start):
            return np.zeros(0, np.uint64)
        size = self.end - self.start
        inner = np.concatenate(([0], np.cumsum(size)[:-1]))
        power = np.cumprod(np.full(size.max(), _STEP[which]))
        offset = np.arange(size.sum()) - np.repeat(inner, size)
        return mix(np.add.reduceat(_BYTE[which][self.bytes[self.solid]] * power[offset], inner))

    def sequences(self, hashes: np.ndarray, n: int, which: int = 0) -> np.ndarray:
        """A hash of the n words from each word on. Where a row has fewer left, the value means nothing."""
        out = np.zeros(len(hashes), np.uint64)
        for k in range(min(n, len(hashes))):
            out[: len(hashes) - k] += hashes[k:] * _PLACE[which][k]
        return mix(out)

    def whole(self, n: int) -> np.ndarray:
        """Whether n words of the same row begin at each word."""
        return self.place + n <= np.repeat(self.count, self.count)


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)
