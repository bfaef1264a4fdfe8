"""Periodic runs of words by seeds on diagonals.

A run is a stretch of consecutive words with smallest period q that no neighbouring word extends and that is at least
``max(6, 4 * q)`` words long. On the diagonal of lag q (word i against word i + q) it is a stretch of at least 5 equal
places for q = 1 and of 3 * q for larger q. Lags are taken in classes from 2^j to 2^(j+1) - 1; the least overlap that a
class guarantees is k = 3 * 2^j words (5 for j = 0), and the k-grams of a text are its seeds.

Of the occurrences of a k-gram in one text only neighbouring ones are paired. That loses nothing: k is at least one and a
half periods, so within a run of period q a k-gram comes again after exactly q words, never earlier (otherwise its root
would be a power). The pairs of a class are therefore fewer than the words, however often a k-gram occurs. Each pair whose
lag lies in the class is extended in both directions along its diagonal, word by word; a table with the furthest place
covered of each lag keeps what was extended once from being extended again. k-grams are found by 64-bit hashes; words are
compared as exact dictionary numbers, so a chance hit cannot make a run.

A position can only seed a class if it seeded the one before (its shorter k-gram came again, too), so texts without
repeats cost one pass. Everything happens inside the row: no shuffle, and no state between texts.

Fixed results: a null or empty text has no words, no runs and an empty kept text; a text with fewer than 6 words has no runs;
a null key is kept; repeated rows are judged each for itself; an empty table gives an empty table; very long texts are
handled whole, with memory in proportion to the longest text; columns other than key and text are ignored, so clashing
names do no harm.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

from marklake.llm.words import Chunk, chunks, mix

LEAST, REPEATS = 6, 4
_ODD = np.uint64(0x9E3779B97F4A7C15)
_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


def word_numbers(chunk: Chunk) -> np.ndarray:
    """Equal words of a chunk get the same number, different ones different numbers."""
    size = len(chunk.data)
    inside = np.zeros(size + 1, dtype=np.int8)
    inside[chunk.starts] += 1
    inside[chunk.ends] -= 1
    packed = chunk.data[np.cumsum(inside[:size], dtype=np.int8).astype(bool)]
    offsets = np.zeros(len(chunk.starts) + 1, dtype=np.int64)
    np.cumsum(chunk.ends - chunk.starts, out=offsets[1:])
    words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(chunk.starts), [None, pa.py_buffer(offsets), pa.py_buffer(packed)])
    return words.dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)


def _stretch(same: np.ndarray, other: np.ndarray, forward: bool) -> int:
    """Number of equal entries at the beginning (or end) of two arrays, looked at in growing pieces."""
    n, done, piece = len(same), 0, 32
    while done < n:
        to = min(n, done + piece)
        a, b = (same[done:to], other[done:to]) if forward else (same[n - to : n - done][::-1], other[n - to : n - done][::-1])
        unlike = a != b
        if unlike.any():
            return done + int(unlike.argmax())
        done, piece = to, piece * 4
    return n


def find_runs(ids: np.ndarray, row_word: np.ndarray) -> list[tuple[int, int, int, int]]:
    """(row, start, length, period) of every run; ``row_word`` bounds the rows in ``ids``, starts count from the row's."""
    n = len(ids)
    rows = np.repeat(np.arange(len(row_word) - 1), np.diff(row_word))
    stop = row_word[rows + 1] if n else rows
    one = mix(ids.astype(np.uint64) + mix(rows.astype(np.uint64) + np.uint64(1)))  # equal words of other rows differ
    grams = np.zeros(n, dtype=np.uint64)

    def joined(first: np.ndarray, second: np.ndarray) -> np.ndarray:
        return mix(first * _ODD + second)

    place = np.flatnonzero(np.arange(n) + 5 <= stop)
    two = joined(one[:-1], one[1:]) if n > 1 else one[:0]
    three = joined(two[:-1], one[2:]) if n > 2 else one[:0]
    grams[place] = joined(three[place], three[place + 2]) if len(place) else 0
    out: list[tuple[int, int, int, int]] = []
    size, low, high = 5, 1, 1
    while len(place):
        key = grams[place]
        order = np.argsort(key, kind="stable")
        at, key = place[order], key[order]
        again = key[1:] == key[:-1]
        lag = at[1:] - at[:-1]
        kept = np.zeros(len(at), dtype=bool)
        kept[:-1] |= again
        kept[1:] |= again
        seeds = again & (lag >= low) & (lag <= high)
        out += _extended(ids, rows, row_word, at[:-1][seeds], lag[seeds], size)
        place = np.sort(at[kept])
        # The next class needs longer seeds; their halves are seeds of this one.
        if size == 5:
            place = place[place + 6 <= stop[place]]
            grams[place] = joined(three[place], three[place + 3])
            size, low, high = 6, 2, 3
        else:
            known = np.zeros(n + 1, dtype=bool)
            known[place] = True
            place = place[place + 2 * size <= stop[place]]
            place = place[known[place + size]]
            grams[place] = joined(grams[place], grams[place + size])
            size, low, high = 2 * size, 2 * low, 2 * high + 1
    return sorted(out)


def _extended(ids, rows, row_word, at, lag, size) -> list[tuple[int, int, int, int]]:
    order = np.lexsort((at, lag, rows[at]))
    at, lag = at[order], lag[order]
    # A seed right behind another one on its diagonal is covered by that one's extension.
    head = np.ones(len(at), dtype=bool)
    head[1:] = (at[1:] != at[:-1] + 1) | (lag[1:] != lag[:-1]) | (rows[at[1:]] != rows[at[:-1]])
    out = []
    row, furthest = -1, {}
    for i, q in zip(at[head].tolist(), lag[head].tolist(), strict=True):
        if rows[i] != row:
            row, furthest = int(rows[i]), {}
        if i < furthest.get(q, -1):
            continue
        first, stop = int(row_word[row]), int(row_word[row + 1])
        right = i + _stretch(ids[i : stop - q], ids[i + q : stop], True)
        if right - i < size:
            continue  # the hashes agreed by chance
        left = i - _stretch(ids[first:i], ids[first + q : i + q], False)
        furthest[q] = right
        length = right - left + q
        if length >= max(LEAST, REPEATS * q):
            out.append((row, left - first, length, q))
    return out


def _kept_text(chunk: Chunk, keep: np.ndarray) -> pa.Array:
    """The kept words of each row, joined by one space."""
    n_rows = chunk.stop - chunk.first
    starts, ends = chunk.starts[keep], chunk.ends[keep]
    rows = chunk.row_of_word()[keep]
    lead = np.ones(len(starts), dtype=bool)
    lead[1:] = rows[1:] != rows[:-1]
    spaced = np.where(lead, starts, starts - 1)  # the byte before a word that isn't its row's first is a separator
    data = chunk.data.copy()
    data[spaced[~lead]] = 0x20
    inside = np.zeros(len(data) + 1, dtype=np.int8)
    inside[spaced] += 1
    inside[ends] -= 1
    data = data[np.cumsum(inside[:-1], dtype=np.int8).astype(bool)]
    sizes = np.zeros(n_rows, dtype=np.int64)
    np.add.at(sizes, rows, ends - spaced)
    offsets = np.zeros(n_rows + 1, dtype=np.int64)
    np.cumsum(sizes, out=offsets[1:])
    return pa.LargeStringArray.from_buffers(n_rows, pa.py_buffer(offsets), pa.py_buffer(data))


def _judged(chunk: Chunk) -> tuple[np.ndarray, pa.Array, pa.Array]:
    """Words, runs and kept text of the rows of a chunk."""
    runs = find_runs(word_numbers(chunk), chunk.row_word)
    dropped = np.zeros(len(chunk.starts) + 1, dtype=np.int64)
    for row, start, length, period in runs:
        first = chunk.row_word[row] + start
        dropped[first + period] += 1
        dropped[first + length] -= 1
    keep = np.cumsum(dropped[:-1]) == 0
    table = np.array(runs, dtype=np.int64).reshape(-1, 4)
    offsets = np.searchsorted(table[:, 0], np.arange(chunk.stop - chunk.first + 1)).astype(np.int32)
    values = pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(table[:, c])) for c in (1, 2, 3)], fields=list(_RUN))
    return np.diff(chunk.row_word), pa.ListArray.from_arrays(offsets, values), _kept_text(chunk, keep)


def periodic_runs(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key``, ``n_words``, ``runs`` (by start, then period) and ``kept_text`` of every row.

    A word is dropped from the kept text if a run holds it after the run's first ``period`` words.
    """
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    kind = rows.schema["key"].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk in chunks(batch.column(1)):
                n_words, runs, kept = _judged(chunk)
                keys = batch.column(0).slice(chunk.first, chunk.stop - chunk.first)
                columns = [keys, pa.array(n_words.astype(np.int64)), runs, kept.cast(pa.string())]
                yield pa.RecordBatch.from_arrays(columns, names=["key", "n_words", "runs", "kept_text"])

    one = StructType([StructField(c, LongType()) for c in ("start", "length", "period")])
    schema = StructType(
        [StructField("key", kind), StructField("n_words", LongType()), StructField("runs", ArrayType(one)), StructField("kept_text", StringType())]
    )
    return rows.mapInArrow(run, schema).withColumnRenamed("key", key)


def longest_run(runs: Column) -> Column:
    """The run of greatest length, of equal ones that of smallest start, then period; null without runs."""
    ranked = F.transform(runs, lambda r: F.struct((-r["length"]).alias("less"), r["start"].alias("start"), r["period"].alias("period")))
    best = F.array_min(ranked)
    return F.when(best.isNotNull(), F.struct(best["start"].alias("start"), (-best["less"]).alias("length"), best["period"].alias("period")))
