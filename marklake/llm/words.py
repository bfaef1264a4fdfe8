"""Words and word windows of whole texts as numpy arrays, straight from Arrow buffers.

A word is a run of bytes other than ``\\x20`` and ``\\x09-\\x0D``; in UTF-8 these bytes occur only as themselves. A
chunk holds several texts, so the numpy calls are shared between short ones; windows never leave their text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 4 << 20
BLOCK_BYTES = 1 << 18

_WORD_BYTE = np.ones(256, dtype=bool)
_WORD_BYTE[[0x20, *range(0x09, 0x0E)]] = False
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective scrambling of 64-bit numbers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    if n:
        out[0] = 1
    return np.multiply.accumulate(out)


@dataclass
class Chunk:
    """Rows ``first`` to ``stop`` of a batch: word bounds in ``data`` and the first word of each row (``row_word``)."""

    first: int
    stop: int
    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    row_word: np.ndarray

    def row_of_word(self) -> np.ndarray:
        return np.repeat(np.arange(self.stop - self.first), np.diff(self.row_word))

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each word. Blocks keep the tables small however long a text is."""
        out = np.empty(len(self.starts), dtype=np.uint64)
        at = 0
        while at < len(out):
            low = int(self.starts[at])
            to = max(at + 1, int(np.searchsorted(self.ends, low + BLOCK_BYTES, side="right")))
            part = self.data[low : int(self.ends[to - 1])]
            if len(part) <= BLOCK_BYTES:
                up, down = _UP[: len(part)], _DOWN
            else:
                up, down = powers(_BASE, len(part)), powers(_INVERSE, len(part))
            sums = np.zeros(len(part) + 1, dtype=np.uint64)
            np.cumsum((part.astype(np.uint64) + np.uint64(1)) * up, out=sums[1:])
            s, e = self.starts[at:to] - low, self.ends[at:to] - low
            out[at:to] = (sums[e] - sums[s]) * down[s]
            at = to
        return mix(out)


_UP, _DOWN = powers(_BASE, BLOCK_BYTES + 1), powers(_INVERSE, BLOCK_BYTES + 1)


def chunks(column: pa.Array) -> Iterator[Chunk]:
    """Split a column of texts (null: empty) into chunks of about ``CHUNK_BYTES``, never inside a text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    if len(column) == 0:
        return
    _, offsets, data = column.buffers()
    bounds = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.empty(0, dtype=np.uint8)
    first = 0
    while first < len(column):
        stop = max(first + 1, int(np.searchsorted(bounds, bounds[first] + CHUNK_BYTES, side="right")) - 1)
        low = bounds[first]
        rows = bounds[first : stop + 1] - low
        part = data[low : low + rows[-1]]
        word = _WORD_BYTE[part]
        edge = np.zeros(len(part) + 1, dtype=bool)  # no word goes on from one text to the next
        edge[rows] = True
        before, after = np.zeros(len(part), dtype=bool), np.zeros(len(part), dtype=bool)
        if len(part):
            before[1:], after[:-1] = word[:-1], word[1:]
            before &= ~edge[:-1]
            after &= ~edge[1:]
        starts = np.flatnonzero(word & ~before)
        ends = np.flatnonzero(word & ~after) + 1
        yield Chunk(first, stop, part, starts, ends, np.searchsorted(starts, rows))
        first = stop


def windows(h: np.ndarray, size: int, base: int = _BASE) -> np.ndarray:
    """A hash of each run of ``size`` consecutive entries (windows over row bounds included)."""
    n = len(h) - size + 1
    if n <= 0:
        return np.empty(0, dtype=np.uint64)
    out, width, block, span = None, 0, h, 1
    todo = size
    while todo:
        if todo & 1:  # append a block of ``span`` entries
            factor = np.uint64(pow(base, span, 1 << 64))
            tail = block[width : width + n]
            out = tail.copy() if out is None else out * factor + tail
            width += span
        todo >>= 1
        if todo:
            factor = np.uint64(pow(base, span, 1 << 64))
            block = block[:-span] * factor + block[span:]
            span *= 2
    return mix(out)


def whole_windows(chunk: Chunk, size: int) -> np.ndarray:
    """Numbers of the words at which a window of ``size`` words starts that stays in its text."""
    counts = np.diff(chunk.row_word)
    start = np.arange(len(chunk.starts))
    return start[start + size <= np.repeat(chunk.row_word[1:], counts)]


def sliding(op: np.ufunc, values: np.ndarray, size: int) -> np.ndarray:
    """``op`` (minimum or maximum) over each run of ``size`` entries."""
    span = 1
    while span * 2 <= size:
        values = op(values[:-span], values[span:]) if len(values) > span else values[:0]
        span *= 2
    rest = size - span
    return values if not rest else op(values[:-rest], values[rest:]) if len(values) > rest else values[:0]
