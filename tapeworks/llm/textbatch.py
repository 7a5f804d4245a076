"""Vectorised views of the texts of an Arrow batch: words, lines and their 64-bit hashes, with numpy only."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_BASE = np.uint64(0x9E3779B97F4A7C15)


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijection of uint64 that spreads every bit (the SplitMix64 finaliser)."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


#: Bytes of text for which a worker's arrays, some 60 bytes for each, take little beside its libraries.
FEW = 1 << 19


def chunks(batch: pa.RecordBatch, column: str = "text", most: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """The batch in slices of about `most` bytes of text, so that memory follows the longest text and not the batch."""
    if not batch.num_rows:
        return
    sizes = np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0), dtype=np.int64)
    part = np.cumsum(sizes) // most
    cuts = np.flatnonzero(np.diff(part)) + 1
    for a, b in zip([0, *cuts], [*cuts, batch.num_rows], strict=True):
        yield batch.slice(a, b - a)


def ragged(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The positions of spans, end to end."""
    return np.repeat(starts - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span of bytes; spans are in order and disjoint."""
    size = ends - starts
    if not len(size):
        return np.zeros(0, np.uint64)
    powers = np.cumprod(np.full(max(1, size.max()), _BASE, np.uint64))
    at = ragged(starts, size)
    value = (data[at].astype(np.uint64) + np.uint64(1)) * powers[at - np.repeat(starts, size)]
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(value)])
    edge = np.concatenate([[0], np.cumsum(size)])
    return mixed((sums[edge[1:]] - sums[edge[:-1]]) ^ size.astype(np.uint64))


def laid_out(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a column's texts end to end, and where each begins (and the last ends). Nulls are empty."""
    column = pc.fill_null(column, "").cast(pa.large_binary())
    off = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)
    return data[off[0] : off[-1]], off - off[0]


class Texts:
    """The texts of one column: bytes end to end, and where each row begins. Nulls are empty."""

    def __init__(self, column: pa.Array):
        self.n = len(column)
        self.data, self.off = laid_out(column)
        self.space = _SPACE[self.data]
        first = self._first()
        prev = np.empty(len(self.data), bool)
        prev[1:] = self.space[:-1]
        prev[first] = True
        self.starts = np.flatnonzero(~self.space & prev)
        nxt = np.empty(len(self.data), bool)
        nxt[:-1] = self.space[1:]
        nxt[first[1:] - 1] = True
        if len(nxt):
            nxt[-1] = True
        self.ends = np.flatnonzero(~self.space & nxt) + 1
        self.row = np.searchsorted(self.off, self.starts, "right") - 1
        self.n_words = np.bincount(self.row, minlength=self.n)

    def _first(self) -> np.ndarray:
        """Where the rows that have bytes begin."""
        return self.off[:-1][np.diff(self.off) > 0]

    def per_row(self, values: np.ndarray) -> np.ndarray:
        """Sums of a value for each byte, by row."""
        total = np.concatenate([[0], np.cumsum(values, dtype=np.int64)])
        return total[self.off[1:]] - total[self.off[:-1]]

    def hashes(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return span_hashes(self.data, starts, ends)

    def word_hashes(self) -> np.ndarray:
        return self.hashes(self.starts, self.ends)
