"""Near-duplicate documents by order MinHash.

The k-mers are runs of five words, each labelled with how often it occurred before, so that repeats count. A sketch
takes the three labelled k-mers that are least under its own hash and keeps them in text order; equal sketches make a
candidate, which is likely for texts with a small edit distance and not for texts that share words in another order.
At a similarity of 0.8, where one of 16 sketches agrees with a probability of about 0.5, one pair in 65,000 is missed.

Candidates are verified by alignment of their k-mer sequences within a band: similarity = common / (all - common),
with ``common`` the longest common subsequence. At 0.8 or more the texts are linked, and connected texts are a group.

Equal texts are one node. Within equal sketches texts are linked through a hub, not in all pairs: every text is aligned
with the one of its bucket that shares the most sketches. Texts of a bucket that still are in different groups are then
aligned with each other, whatever their number, so no link between groups is lost. Before any alignment, lengths and
parity bits bound the similarity from above: each labelled k-mer flips one of 1,024 bits, so the bits in which two texts
differ are at most the k-mers that only one of them has. That bound drops no pair of the similarity asked for.

Fixed results: a null text counts as empty, and all empty texts are equal; a text of one to four words is a single
k-mer; a row whose id is null is in no group (class null); rows that share an id but not the text keep the least id of
their own group; extra columns are ignored.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marklake.llm import words as W
from marklake.llm.components import components
from marklake.storage import stage

K = 5
SKETCHES = 16
LENGTH = 3
SIMILARITY = 0.8
PARITY_WORDS = 16
_SEEDS = W.mix(np.arange(1, SKETCHES + 1, dtype=np.uint64) * np.uint64(0xA24BAED4963EE407))


def _kmers(chunk: W.Chunk) -> list[np.ndarray]:
    """The k-mers of each text of the chunk."""
    h = chunk.hashes()
    runs = W.windows(h, K)
    out = []
    for a, b in zip(chunk.row_word[:-1].tolist(), chunk.row_word[1:].tolist(), strict=True):
        if b - a >= K:
            out.append(runs[a : b - K + 1])
        else:
            out.append(W.windows(h[a:b], b - a) if b > a else np.empty(0, dtype=np.uint64))
    return out


def _labelled(kmers: np.ndarray) -> np.ndarray:
    order = np.argsort(kmers, kind="stable")
    s = kmers[order]
    new = np.ones(len(s), dtype=bool)
    new[1:] = s[1:] != s[:-1]
    if new.all():
        return kmers
    at = np.arange(len(s))
    seen = np.empty(len(s), dtype=np.uint64)
    seen[order] = at - np.maximum.accumulate(np.where(new, at, 0))
    return np.where(seen > 0, W.mix(kmers + seen * np.uint64(0x9E3779B97F4A7C15)), kmers)


def parity(labelled: np.ndarray) -> np.ndarray:
    odd = np.bincount((labelled >> np.uint64(32)).astype(np.int64) % (64 * PARITY_WORDS), minlength=64 * PARITY_WORDS) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def sketches(labelled: np.ndarray) -> np.ndarray:
    if not len(labelled):
        return np.empty(0, dtype=np.uint64)
    take = min(LENGTH, len(labelled))
    least = np.empty((SKETCHES, take), dtype=np.int64)
    for i, seed in enumerate(_SEEDS):
        ranks = W.mix(labelled ^ seed)
        least[i] = np.argpartition(ranks, take - 1)[:take] if take < len(ranks) else np.arange(take)
    least.sort(axis=1)  # text order
    picked = labelled[least]
    out = _SEEDS.copy()
    for j in range(take):
        out = W.mix(out * np.uint64(0xD6E8FEB86659FD93) + picked[:, j])
    return out


def _sketched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for chunk in W.chunks(batch["text"]):
            kmers = [_labelled(k) for k in _kmers(chunk)]
            part = batch.slice(chunk.first, len(kmers))
            sizes = pa.array([len(k) for k in kmers], pa.int64())
            found = pa.array([sketches(k).view(np.int64) for k in kmers], pa.list_(pa.int64()))
            bits = pa.array([parity(k) for k in kmers], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([part["doc"], part["node"], sizes, found, bits], ["doc", "node", "n", "keys", "bits"])


def common_in_band(x: list[int], y: list[int], band: int) -> int:
    """Length of the longest common subsequence whose pairs lie at most ``band`` places apart.

    One bit for each place of ``x`` inside the band; a zero stands for a place at which the length grows.
    """
    places = defaultdict(list)
    for i, v in enumerate(x):
        places[v].append(i)
    grown, low, bits, full = 0, 0, (1 << min(len(x), band + 1)) - 1, min(len(x), band + 1)
    for j, v in enumerate(y):
        if j - band > low and full:  # the band moves on: its lowest place is settled
            grown += not bits & 1
            bits >>= 1
            full -= 1
            low += 1
        if low + full < len(x) and low + full <= j + band:
            bits |= 1 << full
            full += 1
        hit = 0
        for i in places.get(v, ()):
            if low <= i < low + full:
                hit |= 1 << (i - low)
        hit &= bits
        if hit:
            bits = ((bits + hit) | (bits - hit)) & ((1 << full) - 1)
    return grown + full - bits.bit_count()


def similarity(x: np.ndarray, y: np.ndarray, least: float = SIMILARITY) -> float:
    """common / (all - common), right where it is ``least`` or more; below that it may be too low."""
    n, m = len(x), len(y)
    if not n or not m:
        return float(n == m)
    if min(n, m) < least * max(n, m):
        return 0.0
    band = int((n + m) * (1 - least) / (1 + least)) + 1  # more gaps than that can't reach it
    short = min(n, m)
    differ = np.flatnonzero(x[:short] != y[:short])
    head = int(differ[0]) if len(differ) else short
    differ = np.flatnonzero(x[n - short + head :][::-1] != y[m - short + head :][::-1])
    tail = int(differ[0]) if len(differ) else short - head
    inner = common_in_band(x[head : n - tail].tolist(), y[head : m - tail].tolist(), band)
    common = head + tail + inner
    return common / (n + m - common)


def _verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        held: dict[bytes, np.ndarray] = {}  # a hub is aligned with many texts in a row
        for at in range(0, len(batch), 64):
            part = batch.slice(at, 64)
            sides = []
            for side in "ab":
                nodes = part[side].to_pylist()
                missing = [i for i, x in enumerate(nodes) if x not in held]
                texts = part[f"text_{side}"].take(pa.array(missing, pa.int64()))
                for chunk in W.chunks(texts):
                    held.update(zip([nodes[i] for i in missing[chunk.first : chunk.stop]], (k.copy() for k in _kmers(chunk)), strict=True))
                sides.append(nodes)
            linked = [similarity(held[a], held[b]) >= SIMILARITY for a, b in zip(*sides, strict=True)]
            if sum(len(k) for k in held.values()) > 4_000_000:
                held.clear()
            yield pa.RecordBatch.from_arrays([part["a"], part["b"], pa.array(linked)], ["a", "b", "linked"])


def _verify(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """``a``, ``b``, ``linked`` of the pairs, written."""
    left = texts.select(F.col("node").alias("a"), F.col("text").alias("text_a"))
    right = texts.select(F.col("node").alias("b"), F.col("text").alias("text_b"))
    both = pairs.join(left, "a").join(right, "b").select("a", "b", "text_a", "text_b")
    return stage(both.mapInArrow(_verified, "a binary, b binary, linked boolean"), "aligned")


def _grouped(members: DataFrame, links: DataFrame) -> DataFrame:
    """The bucket members with their group so far (``root``)."""
    found = stage(components(links), "groups").withColumnRenamed("node", "g_node")
    joined = members.join(found, members["node"] == found["g_node"], "left")
    return joined.select("key", "node", "n", "bits", "keys", F.coalesce("root", "node").alias("root"))


def _may_be_near(n: str, bits: str, m: str, other_bits: str) -> Column:
    """Lengths and parity bits allow the similarity: common >= s / (1 + s) of both lengths together."""
    apart = sum((F.bit_count(F.get(bits, i).bitwiseXOR(F.get(other_bits, i))) for i in range(1, PARITY_WORDS)), F.bit_count(F.get(bits, 0).bitwiseXOR(F.get(other_bits, 0))))
    both = F.col(n) + F.col(m)
    return (F.least(n, m) >= SIMILARITY * F.greatest(n, m)) & (apart <= both * ((1 - SIMILARITY) / (1 + SIMILARITY)) + 1e-6)


NODE = "substring(unhex(sha2(coalesce({}, ''), 256)), 1, 16)"


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id`` and ``class_id``, the least id of its group, for every row."""
    return _classes(docs, doc_id, text).select(F.col("doc").alias(doc_id), F.col("least.doc").alias("class_id"))


def _classes(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """``doc``, ``node`` of every row with the ``least`` (doc, node) of its group."""
    rows = docs.select(F.col(doc_id).alias("doc"), F.coalesce(text, F.lit("")).alias("text"))
    kind = rows.schema["doc"].dataType.simpleString()
    rows = rows.withColumn("node", F.expr(NODE.format("text")))
    sketched = rows.select("doc", "node", "text").mapInArrow(_sketched, f"doc {kind}, node binary, n bigint, keys array<bigint>, bits array<bigint>")
    sketched = stage(sketched, "sketches")
    nodes = sketched.where("doc IS NOT NULL").groupBy("node").agg(F.min("doc").alias("doc"), F.first("n").alias("n"), F.first("keys").alias("keys"), F.first("bits").alias("bits"))

    # Buckets of two texts or more. A text's weight is how many others its buckets hold; the heaviest is the hub.
    members = nodes.select("node", "doc", "n", "bits", "keys", F.explode(F.array_distinct("keys")).alias("key"))
    sizes = members.groupBy("key").agg(F.count("*").alias("c")).where("c > 1").withColumnRenamed("key", "s_key")
    members = stage(members.join(sizes, members["key"] == sizes["s_key"]).drop("s_key"), "buckets")
    weights = members.groupBy("node").agg(F.sum("c").alias("weight")).withColumnRenamed("node", "w_node")
    weighed = members.join(weights, members["node"] == weights["w_node"])
    hubs = weighed.groupBy("key").agg(F.max(F.struct("weight", "node", "n", "bits")).alias("hub")).withColumnRenamed("key", "h_key")
    hubs = stage(hubs.select("h_key", F.col("hub.node").alias("hub"), F.col("hub.n").alias("hub_n"), F.col("hub.bits").alias("hub_bits")), "hubs")
    pairs = members.join(hubs, (members["key"] == hubs["h_key"]) & (members["node"] != hubs["hub"]) & _may_be_near("n", "bits", "hub_n", "hub_bits"))
    pairs = pairs.select(F.least("node", "hub").alias("a"), F.greatest("node", "hub").alias("b")).distinct()

    wanted = members.select(F.col("node").alias("w_node"), F.col("doc").alias("w_doc")).distinct()
    texts = rows.join(wanted, (rows["doc"] == wanted["w_doc"]) & (rows["node"] == wanted["w_node"]), "left_semi")
    texts = stage(texts.select("node", "text").dropDuplicates(["node"]), "texts")

    tried = _verify(pairs, texts)
    # Whatever still lies in one bucket but in different groups: the texts outside its largest group with all others.
    grouped = stage(_grouped(members.select("key", "node", "n", "bits", "keys"), tried.where("linked").select("a", "b")), "members")
    sizes = grouped.groupBy("key", "root").agg(F.count("*").alias("c")).groupBy("key").agg(F.max(F.struct("c", "root")).alias("top"), F.count("*").alias("groups"))
    sizes = sizes.where("groups > 1").select(F.col("key").alias("s_key"), F.col("top.root").alias("top"))
    minor = grouped.join(sizes, (grouped["key"] == sizes["s_key"]) & (grouped["root"] != sizes["top"]))
    minor = minor.select(F.col("key").alias("x_key"), F.col("node").alias("x"), F.col("n").alias("x_n"), F.col("bits").alias("x_bits"), F.col("keys").alias("x_keys"), F.col("root").alias("x_root"))
    apart = (grouped["key"] == minor["x_key"]) & (grouped["root"] != minor["x_root"]) & _may_be_near("n", "bits", "x_n", "x_bits")
    apart = apart & (F.array_min(F.array_intersect("keys", "x_keys")) == F.col("key"))  # once, whatever buckets they share
    pairs = minor.join(grouped, apart).select("x", F.col("node").alias("y"))
    tried = tried.union(_verify(_untried(pairs, tried), texts))

    found = components(tried.where("linked").select("a", "b"))
    member = nodes.select("node", "doc").join(found.withColumnRenamed("node", "c_node"), F.col("node") == F.col("c_node"), "left")
    member = stage(member.select("node", "doc", F.coalesce("root", "node").alias("root")), "groups")
    least = member.groupBy(F.col("root").alias("l_root")).agg(F.min(F.struct("doc", "node")).alias("least"))
    classes = member.join(least, member["root"] == least["l_root"]).select(F.col("node").alias("c_node"), "least")
    out = sketched.join(classes, (sketched["node"] == classes["c_node"]) & sketched["doc"].isNotNull(), "left")
    return out.select("doc", "node", "least")


def _untried(pairs: DataFrame, tried: DataFrame) -> DataFrame:
    pairs = pairs.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
    return pairs.join(tried.select("a", "b"), ["a", "b"], "left_anti")


def first_of_group(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of each group, that of the least id; rows without an id stay."""
    found = _classes(docs, doc_id, text).where("doc IS NOT NULL")
    later = found.where("doc != least.doc OR node != least.node").select(F.col("doc").alias("l_doc"), F.col("node").alias("l_node")).distinct()
    rows = docs.withColumn("_node", F.expr(NODE.format(text)))
    kept = rows.join(later, (rows[doc_id] == later["l_doc"]) & (rows["_node"] == later["l_node"]), "left_anti")
    once = kept.where(F.col(doc_id).isNotNull()).dropDuplicates([doc_id, "_node"])
    return once.unionByName(kept.where(F.col(doc_id).isNull())).drop("_node")
