"""Best-fit packing of tokenized documents into sequences.

Documents are encoded once and cut only where they are longer than a sequence; the pieces, without their tokens, are
written to the shared folder. Best-fit decreasing then takes the longest piece first and puts it into the open sequence
with the least room that holds it. A segment tree over the remaining capacities finds that one in logarithmic time.

Pieces that fill a sequence are one by themselves. The others are dealt by row into groups of about 65,536; every
group is packed in one task, whose memory that bounds, at the cost of about one partly filled sequence a group.

Fixed results: a null text counts as empty and is the end token alone; repeated rows are packed once each; an empty
table gives no piece. Extra columns are ignored. Texts are encoded whole.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marklake.storage import stage

CAPACITY = 1024
END = 2
GROUP = 65_536
# The pattern that byte-level vocabularies of this kind split by (fixed).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
# The same without the look-ahead, for texts in which no two white-space characters meet: a much faster automaton.
PLAIN_PATTERN = PATTERN.replace(r"\s+(?!\S)|\s+", r"\s")
_RUN = re.compile(r"\s\s")
_PROBE = "It's 12 tests,\n\n  né  à\t.\U0001f600"


def _byte_names() -> dict[str, int]:
    """The characters that stand for bytes in byte-level vocabularies: printable ones for themselves, the others for
    those from 256 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


class Encoder:
    """Token ids of a byte-level BPE in ``tokenizers`` format, as little-endian unsigned 32-bit numbers.

    Texts that hold a special token's string go through ``tokenizers``. All others are merged by ``tiktoken`` under the
    ranks of the same vocabulary, which takes a fifth of the time for the same ids.
    """

    def __init__(self, path: str) -> None:
        import tiktoken
        from tokenizers import Tokenizer

        self._tokenizer = Tokenizer.from_file(path)
        self._special = sorted({t.content for t in self._tokenizer.get_added_tokens_decoder().values()})
        names = _byte_names()
        ranks = {bytes(names[c] for c in t): i for t, i in self._tokenizer.get_vocab().items() if t not in self._special}
        self._merges = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self._plain = tiktoken.Encoding("plain", pat_str=PLAIN_PATTERN, mergeable_ranks=ranks, special_tokens={})
        if self._merged(_PROBE) != self._whole(_PROBE):
            raise ValueError(f"{path} isn't a byte-level BPE of this pattern")

    def _whole(self, text: str) -> bytes:
        return np.array(self._tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def _merged(self, text: str) -> bytes:
        merges = self._merges if _RUN.search(text) else self._plain
        return merges.encode_to_numpy(text, disallowed_special=()).astype("<u4", copy=False).tobytes()

    def encode(self, text: str) -> bytes:
        return self._whole(text) if any(s in text for s in self._special) else self._merged(text)


@lru_cache(maxsize=4)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def cut_documents(docs: DataFrame, tokenizer_path: str, doc_id: str = "doc_id", text: str = "text", capacity: int = CAPACITY, end: int = END, with_ids: bool = False) -> DataFrame:
    """``doc_id``, ``piece``, ``start``, ``length``, ``ids_crc32`` and, if asked for, ``ids`` (little-endian binary).

    A document is its tokens and ``end``. Of a longer one all pieces are full but the first.
    """
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(text, F.lit("")).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    last = np.array([end], dtype="<u4").tobytes()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs as many tasks as there are cores
        held = encoder(tokenizer_path)
        for batch in batches:
            for at in range(0, len(batch), 256):
                part = batch.slice(at, 256)
                row, piece, start, length, crc, ids = [], [], [], [], [], []
                for i, t in enumerate(part["text"]):
                    data = held.encode(t.as_py()) + last
                    n = len(data) // 4
                    edges = [0, *range(n % capacity or min(n, capacity), n + 1, capacity)]
                    for k, (a, b) in enumerate(zip(edges, edges[1:], strict=False)):
                        row.append(i)
                        piece.append(k)
                        start.append(a)
                        length.append(b - a)
                        crc.append(zlib.crc32(memoryview(data)[4 * a : 4 * b]))
                        if with_ids:
                            ids.append(data[4 * a : 4 * b])
                columns = [part["doc_id"].take(pa.array(row, pa.int64())), pa.array(piece, pa.int32())]
                columns += [pa.array(x, pa.int64()) for x in (start, length, crc)] + [pa.array(ids, pa.binary())] * with_ids
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "piece", "start", "length", "ids_crc32", "ids"][: len(columns)])

    return rows.mapInArrow(cut, f"doc_id {kind}, piece int, start bigint, length bigint, ids_crc32 bigint" + ", ids binary" * with_ids)


class OpenBins:
    """Bins by remaining capacity: a segment tree whose nodes count the open bins below them."""

    def __init__(self, capacity: int) -> None:
        self.width = 1 << capacity.bit_length()
        self.count = [0] * (2 * self.width)
        self.bins: list[list[int]] = [[] for _ in range(self.width)]

    def add(self, room: int, number: int) -> None:
        self.bins[room].append(number)
        at = room + self.width
        while at:
            self.count[at] += 1
            at >>= 1

    def take(self, room: int) -> tuple[int, int] | None:
        """Remove the bin with the least room of at least ``room``: its room and number."""
        at, count = room + self.width, self.count
        while not count[at]:
            while at & 1:  # a right child: nothing further right below its parent
                at >>= 1
            if not at:
                return None
            at += 1
            if at & (at - 1) == 0:  # past the last leaf of this level
                return None
        while at < self.width:
            at = 2 * at if count[2 * at] else 2 * at + 1
        found = at - self.width
        number = self.bins[found].pop()
        while at:
            count[at] -= 1
            at >>= 1
        return found, number


def best_fit_decreasing(lengths: np.ndarray, capacity: int = CAPACITY) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each length."""
    bins, offsets = np.empty(len(lengths), dtype=np.int64), np.empty(len(lengths), dtype=np.int64)
    tree, opened = OpenBins(capacity), 0
    for i in np.argsort(-lengths, kind="stable").tolist():
        n = int(lengths[i])
        found = tree.take(n)
        if found is None:
            found, opened = (capacity, opened), opened + 1
        room, number = found
        bins[i], offsets[i] = number, capacity - room
        if room > n:
            tree.add(room - n, number)
    return bins, offsets


def pack(pieces: DataFrame, capacity: int = CAPACITY, group: int = GROUP) -> DataFrame:
    """``pieces`` (with ``length``, 1 to ``capacity``) with ``sequence_id`` and ``offset``."""
    columns = [f for f in pieces.schema if f.name not in ("sequence_id", "offset")]
    names = [f.name for f in columns]
    rows = stage(pieces.select(*names).withColumn("_row", F.monotonically_increasing_id()), "pieces")
    full = rows.where(F.col("length") >= capacity)
    full = full.select(*names, (-1 - F.col("_row")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    part = rows.where(F.col("length") < capacity)
    groups = max(1, -(-part.count() // group))
    part = part.withColumn("_group", F.pmod(F.xxhash64("_row"), F.lit(groups)))

    def fill(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("_row", ignore_index=True)
        bins, offsets = best_fit_decreasing(frame["length"].to_numpy(), capacity)
        out = frame[names].copy()
        out["sequence_id"], out["offset"] = frame["_group"].to_numpy() * (1 << 32) + bins, offsets
        return out

    schema = full.schema
    return full.unionByName(part.groupBy("_group").applyInPandas(fill, schema))


def sequences(packed: DataFrame) -> DataFrame:
    """``sequence_id`` and its token ``ids`` (binary), of packed pieces that carry ``ids``; each is one bounded group."""
    parts = F.sort_array(F.collect_list(F.struct("offset", "ids")))
    return packed.groupBy("sequence_id").agg(F.aggregate(parts, F.lit(b""), lambda a, x: F.concat(a, x["ids"])).alias("ids"))
