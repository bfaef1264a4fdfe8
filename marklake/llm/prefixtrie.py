"""A prefix trie over conversations, as node tables addressed by minimal perfect hashes.

Conversations that begin with the same turns share the nodes of these turns; a node is a distinct sequence of first turns,
its digest chained from its parent's. The job in four steps, none of which holds a whole node, subtree or table in one task:

1. Prefixes. Turns are digested where they are read (128 bits; texts aren't shuffled), brought together by family (a
   conversation and those that borrow its beginning) and streamed in order; each prefix becomes a row.
2. Nodes. An aggregate by digest counts the members of each node and of those that end there, and names the smallest one,
   which owns the node.
3. Shards. The rows are dealt by ranges of their first turns and id, so a shard holds neighbouring paths, and a beginning
   that very many conversations share is cut by id. A shard enumerates its distinct digests, gives each a slot by a minimal
   perfect hash, checks every digest against the table, and scatters the counts of the nodes that its conversations own
   into flat arrays. Adding these up along the parents' slots, deepest first, makes its part of every subtree sum. Nodes
   are owned once, so parts of different shards add up.
4. Sums. The parts of a node are added by an aggregate.

The ids that end at a node are hashed in order: sorted by ranges of (node, id), packed into strings, and the few strings of
a node streamed through one hash.

Fixed results: turns are ordered by (turn, role, digest), nulls first; a null role or text counts as empty; repeated rows are
turns of their own; rows with a null id belong to no conversation and take no part; an empty table gives an empty result;
very long texts are one digest and conversations of any length are streamed; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marklake.storage import stage

BORROWED = 8
LEAD = 4
BATCH = 4096
SHARD_ROWS = 1 << 20
PACKED_IDS = 1 << 14
ROOT = bytes(16)
_STEP, _MIX = 0x9E3779B97F4A7C15, (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))


class NodeTable:
    """A minimal perfect hash over distinct 128-bit digests: n digests, slots 0 to n - 1.

    Digests go to a bit array twice as long as they are many; those alone at their bit stay, the others try again in the
    next, smaller array. A digest's slot is the number of set bits before its own. ``held`` keeps the digest of each slot,
    against which every look-up is checked.
    """

    def __init__(self, digests: np.ndarray) -> None:
        self.levels: list[tuple[np.ndarray, np.ndarray]] = []
        left, base = digests, 0
        while len(left):
            size = 2 * len(left) + 1
            at = self._bit(left, len(self.levels), size)
            alone = np.bincount(at, minlength=size) == 1
            before = base + np.cumsum(alone) - alone
            self.levels.append((alone, before))
            base += int(alone.sum())
            left = left[~alone[at]]
        self.held = np.empty_like(digests)
        self.held[self._slots(digests)] = digests
        self.slots(digests)

    @staticmethod
    def _bit(digests: np.ndarray, level: int, size: int) -> np.ndarray:
        x = digests[:, 0] + np.uint64(level * _STEP % (1 << 64))
        x = (x ^ (x >> np.uint64(31))) * _MIX[0] + digests[:, 1]
        x = (x ^ (x >> np.uint64(29))) * _MIX[1]
        return ((x ^ (x >> np.uint64(32))) % np.uint64(size)).astype(np.int64)

    def _slots(self, digests: np.ndarray) -> np.ndarray:
        out = np.full(len(digests), -1, dtype=np.int64)
        todo = np.arange(len(digests))
        for level, (alone, before) in enumerate(self.levels):
            at = self._bit(digests[todo], level, len(alone))
            here = alone[at]
            out[todo[here]] = before[at[here]]
            todo = todo[~here]
        return out

    def slots(self, digests: np.ndarray) -> np.ndarray:
        """The slot of each digest; one that the table does not hold fails."""
        found = self._slots(digests)
        if len(digests) and (found.min() < 0 or not np.array_equal(self.held[found], digests)):
            raise ValueError("a digest is not in the node table, or shares a slot")
        return found


def _as_pairs(column: pa.Array) -> np.ndarray:
    """Binary(16) values as two 64-bit numbers each."""
    return np.frombuffer(column.cast(pa.binary(16)).buffers()[1], dtype=np.uint64).reshape(-1, 2)[column.offset : column.offset + len(column)]


def _as_binary(pairs: np.ndarray) -> pa.Array:
    return pa.Array.from_buffers(pa.binary(16), len(pairs), [None, pa.py_buffer(np.ascontiguousarray(pairs))]).cast(pa.binary())


def _names(ddl: str) -> list[str]:
    return [c.split()[0] for c in ddl.split(", ")]


PREFIXES = "conv_id long, depth long, digest binary, n_bytes long, ends boolean, lead binary"


def prefixes(turns: DataFrame, borrow: Column | None = None, base: Column | None = None) -> DataFrame:
    """A row for each prefix of each conversation of ``turns`` (``conv_id``, ``turn``, ``role``, ``text``), root included.

    ``borrow`` (of conv_id, at most ``BORROWED``) is the number of first turns that are taken from the conversation ``base``
    (all if it has fewer, none if it is absent) in place of a conversation's own first turns.
    """
    role, text = F.coalesce(F.col("role"), F.lit("")), F.coalesce(F.col("text"), F.lit(""))
    digest = F.unhex(F.md5(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text)))
    rows = turns.where("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long").alias("conv_id"), "turn", role.alias("role"), digest.alias("digest"),
        F.octet_length(text).cast("long").alias("n_bytes"),
    )
    rows = rows.withColumn("base", F.col("conv_id") if base is None else base.cast("long"))
    rows = rows.withColumn("borrow", (F.lit(0) if borrow is None else borrow).cast("int"))
    order = ["base", F.col("conv_id") != F.col("base"), "conv_id", F.col("turn").asc_nulls_first(), "role", "digest"]
    dealt = rows.repartition("base").sortWithinPartitions(*order).select("base", "conv_id", "borrow", "digest", "n_bytes")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = _Prefixes()
        family = None
        shared: list[tuple[bytes, int]] = []  # the first turns of the family's base
        position = 0
        for batch in batches:
            for base, conv, h, digest, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if base != family:
                    family, shared = base, []
                if conv != out.conv:
                    out.close()
                    out.open(conv)
                    position = 0
                    for held in shared[:h] if conv != base else ():
                        out.add(*held)
                if conv == base and position < BORROWED:
                    shared.append((digest, n))
                if conv == base or position >= h:
                    out.add(digest, n)
                position += 1
            if len(out.rows) >= BATCH:
                yield out.batch()
        out.close()
        yield out.batch()

    return dealt.mapInArrow(run, PREFIXES)


class _Prefixes:
    """Prefix rows of one conversation after another. Rows wait until their conversation's lead is known and until it
    is known which of them is the last; a long conversation's rows don't wait for its end."""

    def __init__(self) -> None:
        self.rows: list[tuple] = []
        self.waiting: list[tuple] = []
        self.conv: int | None = None

    def open(self, conv: int) -> None:
        self.conv, self.digest, self.depth, self.lead = conv, ROOT, 0, b""
        self.waiting = [(ROOT, 0)]

    def add(self, turn: bytes, n_bytes: int) -> None:
        self.digest = hashlib.blake2b(self.digest + turn, digest_size=16).digest()
        if len(self.lead) < 8 * LEAD:
            self.lead += self.digest[:8]
        self.waiting.append((self.digest, n_bytes))
        if len(self.waiting) > BATCH:
            self._flush(self.waiting[:-1])
            self.waiting = self.waiting[-1:]

    def _flush(self, rows: list[tuple], last: bool = False) -> None:
        for i, (digest, n_bytes) in enumerate(rows, 1):
            self.rows.append((self.conv, self.depth, digest, n_bytes, last and i == len(rows), self.lead))
            self.depth += 1

    def close(self) -> None:
        if self.conv is not None:
            self._flush(self.waiting, True)
        self.conv = None

    def batch(self) -> pa.RecordBatch:
        columns = list(zip(*self.rows, strict=True)) or [[]] * 6
        self.rows = []
        kinds = (pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.bool_(), pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(c, type=k) for c, k in zip(columns, kinds, strict=True)], names=_names(PREFIXES))


PARTS = "digest binary, conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved long"


def _shard(conv, depth, n_bytes, n_convs, n_ends, owner, digest) -> pa.RecordBatch:
    """A shard's part of every node that its paths touch. Rows are whole conversations, each from the root down."""
    own = owner == conv
    at = np.flatnonzero(depth == 0)
    owning = np.logical_or.reduceat(own, at) if len(at) else own[:0]
    # The paths of conversations that own nothing are held by others, too.
    use = np.repeat(owning, np.diff(np.append(at, len(conv))))
    above = np.maximum(np.arange(len(conv)) - 1, 0)
    parent_owner, parent = owner[above][use], digest[above][use]
    conv, depth, n_bytes, n_convs, n_ends, own, digest = (x[use] for x in (conv, depth, n_bytes, n_convs, n_ends, own, digest))
    top = depth == 0
    parent[top] = digest[top]
    order = np.lexsort((digest[:, 1], digest[:, 0]))
    new = np.ones(len(order), dtype=bool)
    new[1:] = (digest[order[1:]] != digest[order[:-1]]).any(axis=1)
    table = NodeTable(digest[order[new]])
    size = len(table.held)
    slot, up = table.slots(digest), table.slots(parent)
    parent_slot, level = np.zeros(size, dtype=np.int64), np.zeros(size, dtype=np.int64)
    parent_slot[slot], level[slot] = up, depth
    leaves, saved, facts = np.zeros(size, dtype=np.int64), np.zeros(size, dtype=np.int64), np.zeros((size, 4), dtype=np.int64)
    mine = slot[own]
    leaves[mine] = (n_convs == n_ends)[own]
    saved[mine] = ((n_convs - 1) * n_bytes)[own]
    facts[mine] = np.stack([conv, depth, parent_owner, n_convs], axis=1)[own]
    children = np.bincount(up[own & ~top], minlength=size)
    by_depth = np.argsort(level, kind="stable")
    bounds = np.searchsorted(level[by_depth], np.arange(int(level.max(initial=0)) + 2))
    for d in range(len(bounds) - 2, 0, -1):
        nodes = by_depth[bounds[d] : bounds[d + 1]]
        np.add.at(leaves, parent_slot[nodes], leaves[nodes])
        np.add.at(saved, parent_slot[nodes], saved[nodes])
    owned = np.zeros(size, dtype=bool)
    owned[mine] = True
    known = [pa.array(facts[:, c], mask=~owned | ((level == 0) if c == 2 else False)) for c in range(4)]
    return pa.RecordBatch.from_arrays([_as_binary(table.held), *known, pa.array(children), pa.array(leaves), pa.array(saved)], names=_names(PARTS))


def _shard_parts(paths: DataFrame, nodes: DataFrame) -> DataFrame:
    rows = paths.join(nodes, "digest")
    dealt = rows.repartitionByRange("lead", "conv_id").sortWithinPartitions("lead", "conv_id", "depth")
    columns = ["conv_id", "depth", "n_bytes", "n_convs", "n_ends", "owner"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []
        n = 0
        for batch in batches:
            held.append([*(batch.column(c).to_numpy() for c in columns), _as_pairs(batch.column("digest"))])
            n += batch.num_rows
            if n >= SHARD_ROWS:
                arrays = [np.concatenate(a) for a in zip(*held, strict=True)]
                cut = int(np.flatnonzero(arrays[1] == 0)[-1])  # the last conversation may go on
                if cut:
                    yield _shard(*(a[:cut] for a in arrays))
                held, n = [[a[cut:] for a in arrays]], n - cut
        if n:
            yield _shard(*(np.concatenate(a) for a in zip(*held, strict=True)))

    return dealt.select(*columns, "digest").mapInArrow(run, PARTS)


def _end_digests(paths: DataFrame) -> DataFrame:
    """``digest``, ``ends_sha256``: of the ids that end at a node, ascending, joined by commas."""
    packed = "digest binary, first long, ids string"
    ends = paths.where("ends").select("digest", "conv_id")
    dealt = ends.repartitionByRange("digest", "conv_id").sortWithinPartitions("digest", "conv_id")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, ids, out = None, [], []

        def close() -> None:
            if ids:
                out.append((node, ids[0], ",".join(map(str, ids))))

        def made() -> pa.RecordBatch:
            columns = list(zip(*out, strict=True)) or [[]] * 3
            return pa.RecordBatch.from_arrays([pa.array(c, type=k) for c, k in zip(columns, (pa.binary(), pa.int64(), pa.string()), strict=True)], names=_names(packed))

        for batch in batches:
            for digest, conv in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if digest != node or len(ids) == PACKED_IDS:
                    close()
                    node, ids = digest, []
                ids.append(conv)
            yield made()
            out = []
        close()
        yield made()

    schema = "digest binary, ends_sha256 string"

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, state = None, None
        for batch in batches:
            nodes, found = [], []
            for digest, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if digest != node:
                    if state is not None:
                        nodes.append(node)
                        found.append(state.hexdigest())
                    node, state = digest, hashlib.sha256(ids.encode())
                else:
                    state.update(b"," + ids.encode())
            yield pa.RecordBatch.from_arrays([pa.array(nodes, type=pa.binary()), pa.array(found, type=pa.string())], names=_names(schema))
        if state is not None:
            yield pa.RecordBatch.from_arrays([pa.array([node], type=pa.binary()), pa.array([state.hexdigest()])], names=_names(schema))

    strings = dealt.mapInArrow(pack, packed).repartition("digest").sortWithinPartitions("digest", "first")
    return strings.select("digest", "ids").mapInArrow(hashed, schema)


def prefix_trie(turns: DataFrame, borrow: Column | None = None, base: Column | None = None) -> DataFrame:
    """A row for each node: ``conv_id`` (smallest member), ``depth``, ``parent_conv_id``, ``n_convs``, ``n_children``,
    ``n_leaves``, ``saved_tokens`` (bytes of the texts that sharing saves in the subtree), ``ends_sha256``."""
    paths = stage(prefixes(turns, borrow, base), "prefixes")
    nodes = paths.groupBy("digest").agg(
        F.count("*").alias("n_convs"), F.min("conv_id").alias("owner"), F.count_if("ends").alias("n_ends")
    )
    # Written, so that the join below reads it by an exchange of its own and may split the paths of a hot node.
    nodes = stage(nodes, "nodes")
    parts = _shard_parts(paths, nodes)
    everything = parts.unionByName(_end_digests(paths), allowMissingColumns=True)
    facts = ("conv_id", "depth", "parent_conv_id", "n_convs")
    sums = {"n_children": "n_children", "n_leaves": "n_leaves", "saved_tokens": "saved"}
    total = everything.groupBy("digest").agg(
        *[F.max(c).alias(c) for c in facts], *[F.sum(c).alias(name) for name, c in sums.items()], F.max("ends_sha256").alias("ends_sha256")
    )
    return total.select(*facts, *sums, F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256"))
