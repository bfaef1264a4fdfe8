"""Substring dedup: a relative Lempel-Ziv parse of every document against all earlier text.

The corpus is indexed in reference blocks: content-defined stretches of up to 34 words around an anchor, the smallest
hash among the 6-word runs of a 20-word window. Equal windows have equal anchors, so a factor of 20 words or more can
only start in a block whose anchor another document (or another place of the same one) holds too. Those blocks are
compared window by window, which finds the factors exactly up to their first and last word; everything else is literal.
Joined windows that occur earlier are the factors, i.e. the duplicate spans.

Three passes read the texts, each partitioned by document: anchors, windows of shared anchors, the parse. What is
shuffled is a hash per anchor (about one for eight words) and one per window in shared blocks; a document sends each of
them once, so a passage that every document repeats is a group of one row a document, sorted and spilled by Spark.

Fixed results: a null or empty text has no words; documents are ordered by id (null first), then by a hash of the
text; rows with equal id and text are one document and get equal results. A text that equals an earlier one is one
factor as a whole. Windows are compared as 128-bit hashes. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from marklake.llm import words as W
from marklake.storage import stage

WINDOW = 20
RUN = 6
SECOND_BASE = 0xD6E8FEB86659FD93 | 1


class _Parsed:
    """Windows of a chunk: start word, row, anchor value and two hashes."""

    def __init__(self, chunk: W.Chunk) -> None:
        h = chunk.hashes()
        self.chunk = chunk
        self.start = W.whole_windows(chunk, WINDOW)
        self.row = chunk.row_of_word()[self.start]
        runs = W.windows(h, RUN)
        least = W.sliding(np.minimum, runs, WINDOW - RUN + 1)
        self.anchor = least[self.start]
        self.low = W.windows(h, WINDOW)[self.start]
        self._hashes = h
        # Places of the anchors: runs that are the least of some window that holds them.
        most = np.zeros(len(runs) + WINDOW - RUN, dtype=np.uint64)
        most[self.start + WINDOW - RUN] = self.anchor
        self.place = np.flatnonzero((W.sliding(np.maximum, most, WINDOW - RUN + 1) == runs[: len(runs)]) & (runs > 0)) if len(runs) else np.empty(0, int)
        self.place_value = runs[self.place] if len(runs) else np.empty(0, np.uint64)
        self.place_row = chunk.row_of_word()[self.place] if len(runs) else np.empty(0, int)

    def high(self) -> np.ndarray:
        return W.windows(self._hashes, WINDOW, SECOND_BASE)[self.start]

    def of_row(self, row: int) -> slice:
        return slice(*np.searchsorted(self.row, [row, row + 1]))


def _anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for chunk in W.chunks(batch["text"]):
            got = _Parsed(chunk)
            order = np.lexsort((got.place_value, got.place_row))
            row, value = got.place_row[order], got.place_value[order]
            first = np.ones(len(row), dtype=bool)
            first[1:] = (row[1:] != row[:-1]) | (value[1:] != value[:-1])
            at = pa.array(row[first] + chunk.first)
            yield pa.RecordBatch.from_arrays(
                [batch["doc"].take(at), batch["tie"].take(at), pa.array(value[first].view(np.int64))], ["doc", "tie", "anchor"]
            )


def _lists(column: pa.Array, first: int, stop: int) -> tuple[np.ndarray, np.ndarray]:
    part = column.slice(first, stop - first)
    sizes = np.asarray(part.value_lengths().fill_null(0))
    return np.asarray(part.flatten()).astype(np.int64).view(np.uint64), np.concatenate([[0], np.cumsum(sizes)])


def _shared_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for chunk in W.chunks(batch["text"]):
            got = _Parsed(chunk)
            high = got.high()
            values, bounds = _lists(batch["found"], chunk.first, chunk.stop)
            keep = []
            for row in range(chunk.stop - chunk.first):
                at = got.of_row(row)
                here = np.flatnonzero(np.isin(got.anchor[at], values[bounds[row] : bounds[row + 1]])) + at.start
                if len(here):
                    keep.append(here[np.unique(got.low[here], return_index=True)[1]])
            here = np.concatenate(keep) if keep else np.empty(0, dtype=int)
            at = pa.array(got.row[here] + chunk.first)
            yield pa.RecordBatch.from_arrays(
                [batch["doc"].take(at), batch["tie"].take(at), pa.array(got.low[here].view(np.int64)), pa.array(high[here].view(np.int64))],
                ["doc", "tie", "low", "high"],
            )


def _covered(got: _Parsed, values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Of each word of the chunk: whether a window that starts earlier elsewhere covers it."""
    copy = np.zeros(len(got.chunk.starts) + 1, dtype=np.int64)
    order = np.lexsort((got.place_value, got.place_row))
    row, value = got.place_row[order], got.place_value[order]
    again = set(row[1:][(row[1:] == row[:-1]) & (value[1:] == value[:-1])].tolist())
    for r in sorted(again | set(np.flatnonzero(np.diff(bounds)).tolist())):
        at = got.of_row(r)
        low = got.low[at]
        hit = np.isin(low, values[bounds[r] : bounds[r + 1]])
        if r in again:
            later = np.ones(len(low), dtype=bool)
            later[np.unique(low, return_index=True)[1]] = False
            hit |= later
        copy[got.start[at][hit]] = 1
    before = np.concatenate([np.zeros(WINDOW, dtype=np.int64), np.cumsum(copy[:-1])])
    return before[WINDOW:] > before[:-WINDOW] if len(copy) > 1 else np.zeros(0, dtype=bool)


def _results(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["doc", "tie", "n_words", "n_removed", "span_start", "span_length", "kept_text"]
    for batch in batches:
        for chunk in W.chunks(batch["text"]):
            got = _Parsed(chunk)
            gone = _covered(got, *_lists(batch["found"], chunk.first, chunk.stop))
            counts = np.diff(chunk.row_word)
            # A text that equals an earlier one is one factor, if it is long enough for any.
            whole = np.asarray(batch["copy"].slice(chunk.first, len(counts))).astype(bool) & (counts >= WINDOW)
            gone |= np.repeat(whole, counts)
            data = chunk.data.tobytes()
            columns: list[list] = [[], [], [], [], []]
            for row in range(len(counts)):
                a, b = int(chunk.row_word[row]), int(chunk.row_word[row + 1])
                lost = gone[a:b]
                edge = np.flatnonzero(np.diff(np.concatenate([[0], lost.view(np.int8), [0]])))
                starts, ends = chunk.starts[a:b][~lost].tolist(), chunk.ends[a:b][~lost].tolist()
                kept = b" ".join([data[s:e] for s, e in zip(starts, ends, strict=True)])
                for column, x in zip(columns, (int(b - a), int(lost.sum()), edge[::2], edge[1::2] - edge[::2], kept.decode()), strict=True):
                    column.append(x)
            kinds = (pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.string())
            made = [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]
            part = batch.slice(chunk.first, len(counts))
            yield pa.RecordBatch.from_arrays([part["doc"], part["tie"], *made], names)


def _same(left: DataFrame, right: DataFrame) -> Column:
    return left["doc"].eqNullSafe(right["r_doc"]) & (left["tie"] == right["r_tie"])


def _renamed(df: DataFrame) -> DataFrame:
    return df.withColumnsRenamed({"doc": "r_doc", "tie": "r_tie"})


def remove_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc``, ``tie``, ``n_words``, ``n_removed``, the factors (``span_start``, ``span_length`` in words) and
    ``kept_text``: the other words, joined by single spaces."""
    tie = F.coalesce(F.xxhash64(text), F.lit(0))
    rows = docs.select(F.col(doc_id).alias("doc"), tie.alias("tie"), F.coalesce(text, F.lit("")).alias("text"))
    kind = rows.schema["doc"].dataType.simpleString()

    ids = rows.select("doc", "tie", F.unhex(F.sha2("text", 256)).alias("digest"))
    firsts = ids.groupBy("digest").agg(F.min(F.struct(F.col("doc").isNotNull().alias("n"), "doc", "tie")).alias("first"), F.count("*").alias("c"))
    # Written, so that the join deals both sides anew and can split the rows of a text with very many copies.
    firsts = stage(firsts.where("c > 1").select(F.col("digest").alias("f_digest"), "first"), "firsts")
    copies = ids.join(firsts, ids["digest"] == firsts["f_digest"]).where(~(F.col("doc").eqNullSafe(F.col("first.doc"))))
    copies = _renamed(copies.select("doc", "tie").distinct()).withColumn("copied", F.lit(True))
    texts = rows.join(copies, _same(rows, copies), "left")
    texts = texts.select("doc", "tie", "text", F.coalesce("copied", F.lit(False)).alias("copy"))

    new = texts.where(~F.col("copy"))
    anchors = new.mapInArrow(_anchors, f"doc {kind}, tie bigint, anchor bigint")
    # Two documents hold it: they differ in id or in text (equal texts of two ids were set aside above).
    by = Window.partitionBy("anchor")
    ends = {f"{f.__name__}_{c}": f(c).over(by) for c in ("doc", "tie") for f in (F.min, F.max)}
    shared = anchors.withColumns(ends).where("min_doc != max_doc OR min_tie != max_tie")
    blocks = _renamed(shared.groupBy("doc", "tie").agg(F.collect_list("anchor").alias("found")))
    hits = new.join(blocks, _same(new, blocks)).select("doc", "tie", "text", "found")

    windows = hits.mapInArrow(_shared_windows, f"doc {kind}, tie bigint, low bigint, high bigint")
    order = F.struct(F.col("doc").isNotNull().alias("n"), "doc", "tie")
    first = F.min(order).over(Window.partitionBy("low", "high"))
    later = windows.withColumn("first", first).where(order != F.col("first"))
    factors = _renamed(later.groupBy("doc", "tie").agg(F.collect_list("low").alias("found")))
    parse = texts.join(factors, _same(texts, factors), "left").select("doc", "tie", "text", "copy", "found")
    return parse.mapInArrow(
        _results,
        f"doc {kind}, tie bigint, n_words bigint, n_removed bigint, span_start array<bigint>, span_length array<bigint>, kept_text string",
    )
