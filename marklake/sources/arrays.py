"""Elements of JSON array files of any size, read in parallel from splits of the files.

Spark's text source cuts a file into splits at a separator, here a closing brace. A first pass finds what each split does to
the nesting and to an open string, whichever state it starts in; summed along a file that tells the state in which each
split starts. A second pass cuts the splits at the commas of the outermost array. Only the two pieces at the ends of a split
have to be brought together with those of its neighbours. Pieces and elements are staged, so each text is cut and put
together once, whatever the number of steps that read it.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from marklake.storage import stage

SEPARATOR = "}"
#: Splits of files that don't fit into one; their states go to the tasks, some fifty bytes each.
MOST_SPLITS = 200_000

_ESCAPED = re.compile(r"\\.", re.DOTALL)
_STRING_END = re.compile(r'[^"\\]*(?:\\.[^"\\]*)*"', re.DOTALL)
_TOKEN = re.compile(r'"[^"\\]*(?:\\.[^"\\]*)*("|\Z)|[\[\]{},]', re.DOTALL)

SUMMARY_DDL = "file string, start long, quotes long, outside long, inside long"
PIECE_DDL = "file string, start long, n long, last boolean, text string"


def _depth(segments: list[str]) -> int:
    return sum(s.count("[") + s.count("{") - s.count("]") - s.count("}") for s in segments)


def _splits(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, int, Iterator[str]]]:
    """File, start and text of each split, the text record by record with its separator."""

    def records():
        held = None
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if held is not None:
                    yield *held, row
                held = row
        if held is not None:
            yield *held, None

    rows = records()
    row = next(rows, None)
    while row is not None:
        file, start = row[1], row[2]

        def own():
            nonlocal row
            while row is not None and (row[1], row[2]) == (file, start):
                value, _, _, end, size, following = row
                at_end = (following is None or following[1:3] != (file, start)) and end >= size
                yield value if at_end else value + SEPARATOR
                row = next(rows, None)

        text = own()
        yield file, start, text
        for _ in text:  # whatever was left
            pass


def _summaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for file, start, texts in _splits(batches):
        quotes, depth = 0, [0, 0]
        for text in texts:
            plain = _ESCAPED.sub("", text) if "\\" in text else text
            segments = plain.split('"')
            for state in (0, 1):
                depth[state] += _depth(segments[(state + quotes) % 2 :: 2])
            quotes += len(segments) - 1
        values = [[file], [start], [quotes], [depth[0]], [depth[1]]]
        yield pa.RecordBatch.from_arrays([pa.array(v) for v in values], names=["file", "start", "quotes", "outside", "inside"])


class _Cutter:
    """Cuts a text at the commas of the outermost array."""

    def __init__(self, in_string: bool, depth: int, opened: bool) -> None:
        self.in_string, self.depth, self.opened = in_string, depth, opened
        self.parts: list[str] = []
        self.bad = False

    def feed(self, text: str) -> Iterator[str]:
        """The pieces that end within ``text``; what follows the last of them is held."""
        at = start = 0
        if self.in_string:
            found = _STRING_END.match(text)
            if not found:
                self.parts.append(text)
                return
            at, self.in_string = found.end(), False
        for token in _TOKEN.finditer(text, at):
            kind = token[0][0]
            if kind == '"':
                self.in_string = token[1] == ""
            elif kind in "[{":
                if self.depth == 0:
                    self.bad |= self.opened or kind != "[" or bool("".join([*self.parts, text[start : token.start()]]).strip())
                    self.parts, start, self.opened = [], token.end(), True
                self.depth += 1
            elif kind in "]}":
                self.depth -= 1
                self.bad |= self.depth < 0
                if self.depth == 0:
                    self.bad |= kind != "]"
                    yield self._piece(text[start : token.start()])
                    start = token.end()
            elif self.depth <= 1:
                self.bad |= self.depth < 1
                yield self._piece(text[start : token.start()])
                start = token.end()
        self.parts.append(text[start:])

    def _piece(self, end: str) -> str:
        piece, self.parts = "".join([*self.parts, end]), []
        return piece


def _pieces(states: dict[tuple[str, int], tuple[bool, int]]):
    """``n`` counts the pieces of a split; the last one goes on in the next split. A broken split has a row with n = -1."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        size = 0

        def batch() -> pa.RecordBatch:
            kinds = (pa.string(), pa.int64(), pa.int64(), pa.bool_(), pa.string())
            columns = list(zip(*rows, strict=True)) or [[]] * 5
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["file", "start", "n", "last", "text"])

        for file, start, texts in _splits(batches):
            if start and (file, start) not in states:
                raise ValueError(f"{file} was cut at other places than before; read it again")
            cutter, n = _Cutter(*states.get((file, start), (False, 0)), start > 0), 0
            for text in texts:
                for piece in cutter.feed(text):
                    rows.append((file, start, n, False, piece))
                    size += len(piece)
                    n += 1
                if size > 8 << 20:
                    yield batch()
                    rows, size = [], 0
            rows.append((file, start, n, True, "".join(cutter.parts)))
            if cutter.bad:
                rows.append((file, start, -1, False, None))
        yield batch()

    return run


def read_array_elements(spark: SparkSession, path: str, **options) -> DataFrame:
    """``file, pos, raw``: the elements of the JSON arrays that the files below ``path`` hold.

    Elements are given as ``from_json(.., 'array<string>')`` gives them. A file that isn't one whole array has no
    rows, nor has one with anything else behind the array. Strings must be in double quotes.
    """
    lines = spark.read.options(lineSep=SEPARATOR, **options).text(path)
    meta = F.col("_metadata")
    end = meta["file_block_start"] + meta["file_block_length"]
    lines = lines.select("value", meta["file_path"].alias("file"), meta["file_block_start"].alias("start"), end.alias("end"), meta["file_size"].alias("size"))

    order = W.partitionBy("file").orderBy("start")
    earlier = order.rowsBetween(W.unboundedPreceding, -1)
    summary = lines.mapInArrow(_summaries, SUMMARY_DDL)
    summary = summary.withColumn("string", F.coalesce(F.sum("quotes").over(earlier), F.lit(0)) % 2 == 1)
    change = F.when(F.col("string"), F.col("inside")).otherwise(F.col("outside"))
    summary = summary.withColumn("depth", F.coalesce(F.sum(change).over(earlier), F.lit(0)))
    found = summary.where("start > 0").select("file", "start", "string", "depth").take(MOST_SPLITS + 1)
    if len(found) > MOST_SPLITS:
        raise ValueError(f"more than {MOST_SPLITS} splits; raise spark.sql.files.maxPartitionBytes")
    states = {(r["file"], r["start"]): (r["string"], r["depth"]) for r in found}

    # Read by several steps below, and cut once for all of them.
    pieces = stage(lines.mapInArrow(_pieces(states), PIECE_DDL), "pieces")
    counts = pieces.where("last").select("file", "start", "n")
    before = counts.select(F.col("file").alias("b_file"), F.col("start").alias("b_start"), F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    placed = pieces.join(before, (F.col("file") == F.col("b_file")) & (F.col("start") == F.col("b_start")))
    placed = placed.select("file", "start", "last", "text", F.when(F.col("n") < 0, -1).otherwise(F.col("n") + F.col("before")).alias("pos"), F.col("n") == 0)
    # Inner pieces are elements as they are; those at the ends of splits are put together.
    placed = placed.toDF("file", "start", "last", "text", "pos", "first")
    ends = placed.where("first OR last").groupBy("file", "pos").agg(F.array_sort(F.collect_list(F.struct("start", "text"))).alias("parts"), F.max("start").alias("at"))
    joined = ends.select("file", "pos", F.array_join(F.transform("parts", lambda p: p["text"]), "").alias("text"))
    whole = stage(placed.where("NOT first AND NOT last").select("file", "pos", "text").unionByName(joined), "elements")

    # What follows the array is the last piece of all; an array without elements is one blank piece before it.
    tail = whole.groupBy(F.col("file").alias("t_file")).agg(F.max("pos").alias("tail"))
    whole = whole.join(tail, F.col("file") == F.col("t_file")).drop("t_file")
    blank = ~F.col("text").rlike(r"[^\x20\t\r\n]")
    parsed = F.from_json(F.concat(F.lit("["), "text", F.lit("]")), "array<string>")
    elements = whole.withColumns({"blank": blank, "parsed": parsed})
    is_tail = F.col("pos") == F.col("tail")
    empty = (F.col("pos") == 0) & (F.col("tail") == 1) & F.col("blank")
    wrong = (F.col("pos") < 0) | is_tail & ((F.col("tail") == 0) | ~F.col("blank")) | ~is_tail & ~empty & (F.col("blank") | F.col("parsed").isNull() | (F.size("parsed") != 1))
    elements = elements.withColumn("wrong", F.coalesce(wrong, F.lit(True)))
    broken = elements.where("wrong").select("file").distinct()
    good = elements.where(~is_tail & ~empty).join(broken, "file", "left_anti")
    return good.select("file", F.col("pos").cast("int").alias("pos"), F.get("parsed", F.lit(0)).alias("raw"))
