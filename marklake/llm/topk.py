"""Exact top-k inner products by a three-phase uniform threshold.

The components are cut into lists, each of which scores every vector on its own components. Phase one gathers the k
best of each list, over all tasks, and scores those vectors in full: the k-th best total is a safe cutoff, since k
vectors reach it. Phase two broadcasts it; a vector whose total reaches the cutoff has a list score of at least cutoff /
lists somewhere, so every list sends just the entries that do. Phase three resolves, for entries that can still reach
the cutoff, the scores of the lists that didn't send them, and ranks.

Queries are taken in blocks of about 2,048, whose vectors and cutoffs are what is broadcast; every block goes over all
vectors. Of equal vectors only the k + 1 least ids can be among a query's k best, so no others are scored.

Fixed results: rows whose id or vector is null, or whose vector holds a null, infinite or undefined component, take no
part; repeated rows count once, and of rows that share an id the least vector counts; a shorter vector goes on with
zeros; ties go to the smaller id; extra columns are ignored; no vectors give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from marklake.storage import stage

LISTS = 2
QUERY_BLOCK = 2048
VECTOR_BLOCK = 1024


def integer_codes(vector: Column, scale: int = 256) -> Column:
    """floor(scale * x) of each component, or null where the vector takes no part."""
    sound = F.forall(vector, lambda x: F.coalesce((F.abs(x) < float("inf")) & ~F.isnan(x), F.lit(False)))
    return F.when(sound, F.transform(vector, lambda x: F.floor(F.lit(float(scale)) * x.cast("double"))))


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    sizes = np.asarray(column.value_lengths())
    flat = np.asarray(column.flatten()).astype(np.int64)
    if (sizes == width).all():
        return flat.reshape(-1, width)
    out = np.zeros((len(sizes), width), dtype=np.int64)
    out[np.arange(width) < sizes[:, None]] = flat
    return out


def _products(queries: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Exact integer products; in floating point where no sum can leave its whole numbers."""
    most = int(np.abs(queries).max(initial=0)) * int(np.abs(vectors).max(initial=0)) * queries.shape[1]
    if most < 1 << 53:
        return (queries.astype(np.float64) @ vectors.astype(np.float64).T).astype(np.int64)
    return queries @ vectors.T


class _Block:
    """A block of queries: ids and codes, cut into lists."""

    def __init__(self, rows: list, lists: int) -> None:
        self.ids = np.array([r["vec_id"] for r in rows], dtype=np.int64)
        self.width = max(len(r["codes"]) for r in rows)
        self.codes = np.zeros((len(rows), self.width), dtype=np.int64)
        for i, r in enumerate(rows):
            self.codes[i, : len(r["codes"])] = r["codes"]
        edges = np.linspace(0, self.width, lists + 1).astype(int)
        self.lists = list(zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True))

    def scored(self, batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, list[np.ndarray]]]:
        """Ids of some vectors and, by list, their scores (a row for each query)."""
        for batch in batches:
            ids = np.asarray(batch["vec_id"])
            for at in range(0, len(ids), VECTOR_BLOCK):
                part = batch["codes"].slice(at, VECTOR_BLOCK)
                matrix = _matrix(part, max(self.width, int(np.asarray(part.value_lengths()).max())))
                yield ids[at : at + VECTOR_BLOCK], [_products(self.codes[:, a:b], matrix[:, a:b]) for a, b in self.lists]


def _local_lists(block: _Block, k: int):
    """Each task's k best entries of every list and query."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        least = np.iinfo(np.int64).min
        best = [(np.empty((len(block.ids), 0), np.int64), np.empty((len(block.ids), 0), np.int64)) for _ in block.lists]
        for ids, lists in block.scored(batches):
            own = block.ids[:, None] == ids
            for i, scores in enumerate(lists):
                scores[own] = least
                scores = np.concatenate([best[i][0], scores], axis=1)
                names = np.concatenate([best[i][1], np.broadcast_to(ids, own.shape)], axis=1)
                if scores.shape[1] > k:
                    at = np.argpartition(-scores, k - 1, axis=1)[:, :k]
                    scores, names = np.take_along_axis(scores, at, 1), np.take_along_axis(names, at, 1)
                best[i] = scores, names
        for i, (scores, names) in enumerate(best):
            query, at = np.nonzero(scores > least)
            yield pa.RecordBatch.from_arrays(
                [pa.array(block.ids[query]), pa.array(np.full(len(query), i, np.int32)), pa.array(names[query, at]), pa.array(scores[query, at])],
                ["query_id", "list", "vec_id", "part"],
            )

    return run


def _entries_over(block: _Block, cutoffs: np.ndarray):
    """Entries of at least cutoff / lists, put together by query and vector; those that can't reach it left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = len(block.lists)
        for ids, lists in block.scored(batches):
            cut = cutoffs[:, None]
            sent = [n * x >= cut for x in lists]
            known = sum(np.where(s, x, 0) for s, x in zip(sent, lists, strict=True))
            count = sum(s.astype(np.int32) for s in sent)
            # A list that sent nothing is below cutoff / lists.
            reach = (count > 0) & (n * known + (n - count) * cut >= n * cut) & (block.ids[:, None] != ids)
            query, at = np.nonzero(reach)
            yield pa.RecordBatch.from_arrays(
                [pa.array(block.ids[query]), pa.array(ids[at]), pa.array(known[query, at]), pa.array(count[query, at] == n)],
                ["query_id", "vec_id", "known", "complete"],
            )

    return run


def _totals(pairs: DataFrame, queries: DataFrame, vectors: DataFrame) -> DataFrame:
    q = queries.select(F.col("vec_id").alias("query_id"), F.col("codes").alias("q_codes"))
    both = pairs.join(vectors, "vec_id").join(q, "query_id")
    product = F.zip_with("codes", "q_codes", lambda a, b: F.coalesce(a * b, F.lit(0)))
    return both.select("query_id", "vec_id", F.aggregate(product, F.lit(0).cast("long"), lambda s, x: s + x).alias("score"))


def _ranked(scores: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return scores.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def top_k(vectors: DataFrame, is_query: Column, k: int = 5, vector: str = "embedding", vec_id: str = "vec_id", lists: int = LISTS) -> DataFrame:
    """``query_id``, ``rank``, ``vec_id``, ``score``: the k best other vectors of every row for which ``is_query``, an
    expression over ``vec_id``, holds."""
    rows = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), integer_codes(F.col(vector)).alias("codes"))
    rows = rows.where("vec_id IS NOT NULL AND codes IS NOT NULL").groupBy("vec_id").agg(F.min("codes").alias("codes"))
    rows = stage(rows, "vectors")
    queries = rows.where(is_query)
    number = F.row_number().over(Window.partitionBy("codes").orderBy("vec_id"))
    rows = stage(rows.withColumn("n", number).where(F.col("n") <= k + 1).drop("n"), "vectors")

    blocks = max(1, -(-queries.count() // QUERY_BLOCK))
    done = []
    for b in range(blocks):
        of_block = queries.where(F.pmod(F.xxhash64("vec_id"), F.lit(blocks)) == b)
        held = of_block.collect()  # about QUERY_BLOCK rows
        if not held:
            continue
        block = _Block(held, lists)
        local = rows.mapInArrow(_local_lists(block, k), "query_id long, list int, vec_id long, part long")
        best = Window.partitionBy("query_id", "list").orderBy(F.desc("part"), "vec_id")
        seen = local.withColumn("r", F.row_number().over(best)).where(F.col("r") <= k).select("query_id", "vec_id").distinct()
        cut = _ranked(_totals(seen, of_block, rows), k).where(F.col("rank") == k).select("query_id", "score").collect()
        cut = {r["query_id"]: r["score"] for r in cut}
        # Fewer than k vectors in all: everything is collected.
        cutoffs = np.array([cut.get(i, -(1 << 60)) for i in block.ids.tolist()], dtype=np.int64)
        entries = stage(rows.mapInArrow(_entries_over(block, cutoffs), "query_id long, vec_id long, known long, complete boolean"), "entries")
        known = entries.where("complete").select("query_id", "vec_id", F.col("known").alias("score"))
        rest = _totals(entries.where("NOT complete").select("query_id", "vec_id"), of_block, rows)
        done.append(stage(_ranked(known.unionByName(rest), k).select("query_id", "rank", "vec_id", "score"), "ranked"))
    if not done:
        return rows.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out
