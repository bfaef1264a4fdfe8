"""Sharding by sampled splitters: shards of near equal bytes, cut along the order of a key.

A size-weighted sample of keys gives quantile boundaries, records are range-partitioned by them, and ranges that came
out overfull (a hot key, a sampling error) are subdivided by row. Only DataFrame functions are used.
"""

from __future__ import annotations

from heapq import heapify, heappop, heappush

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from marklake.storage import stage

RANGES_PER_SHARD = 256
SAMPLES_PER_RANGE = 16


def _splitters(rows: DataFrame, key: str, size: str, total: int, ranges: int) -> list[int]:
    """Quantile boundaries of the size-weighted keys; the sample holds about ranges * SAMPLES_PER_RANGE rows."""
    rate = ranges * SAMPLES_PER_RANGE / max(total, 1)
    # How often the row is drawn: its whole expected number, and one more with the probability of the rest.
    wanted = F.col(size) * F.lit(rate)
    chance = F.pmod(F.xxhash64(F.lit(9), F.col("_row")), F.lit(1 << 30)) / F.lit(float(1 << 30))
    drawn = rows.select(F.col(key).alias("k"), (F.floor(wanted) + (chance < wanted - F.floor(wanted)).cast("int")).alias("n"))
    drawn = drawn.where((F.col("n") > 0) & F.col("k").isNotNull()).groupBy("k").agg(F.sum("n").alias("n"))
    before = F.sum("n").over(Window.orderBy("k").rowsBetween(Window.unboundedPreceding, -1))  # over the bounded sample
    marks = drawn.select("k", "n", F.coalesce(before, F.lit(0)).alias("b"))
    step = F.lit(SAMPLES_PER_RANGE)
    cut = marks.where(F.floor((F.col("b") + F.col("n") - 1) / step) != F.floor((F.col("b") - 1) / step))
    return [r["k"] for r in cut.orderBy("k").collect()]


def _range_of(key: Column, bounds: list[int]) -> Column:
    """Number of boundaries at or below the key, by bisection; null keys come before all."""
    if not bounds:
        return F.lit(0)
    held = F.array(*[F.lit(int(b)) for b in bounds]) if len(bounds) <= 8 else F.from_json(F.lit(str(bounds)), "array<bigint>")
    steps = [1 << i for i in reversed(range(len(bounds).bit_length()))]

    def halve(at: Column, step: Column) -> Column:
        to = at + step
        return F.when((to <= len(bounds)) & (F.get(held, to - 1) <= key), to).otherwise(at)

    return F.coalesce(F.aggregate(F.array(*[F.lit(s) for s in steps]), F.lit(0), halve), F.lit(0))


def _place(ranges: list[tuple[int, int, int]], shards: int) -> list[int]:
    """Shard of each (range, part, bytes): along the order at first, then from the fullest shard to the emptiest
    as long as that makes them more equal. The list is bounded by the number of ranges, not by the rows."""
    total, seen, out = sum(b for *_, b in ranges), 0, []
    held: list[list[tuple[int, int]]] = [[] for _ in range(shards)]
    load = [0] * shards
    for i, (_, _, size) in enumerate(ranges):
        s = min(shards - 1, int(shards * (2 * seen + size) // (2 * total))) if total else i % shards
        seen += size
        out.append(s)
        held[s].append((size, i))
        load[s] += size
    low = [(b, s) for s, b in enumerate(load)]
    heapify(low)
    for _ in range(4 * len(ranges)):
        full = max(range(shards), key=load.__getitem__)
        while low[0][0] != load[low[0][1]]:
            heappop(low)
        empty = low[0][1]
        gap = load[full] - load[empty]
        size, i = min(((b, i) for b, i in held[full] if 0 < b < gap), key=lambda x: abs(2 * x[0] - gap), default=(0, -1))
        if i < 0:
            break
        held[full].remove((size, i))
        held[empty].append((size, i))
        load[full] -= size
        load[empty] += size
        out[i] = empty
        heappush(low, (load[full], full))
        heappush(low, (load[empty], empty))
    return out


def shard_by_bytes(records: DataFrame, key: str, size: str, shards: int = 16, ranges_per_shard: int = RANGES_PER_SHARD) -> DataFrame:
    """``records`` with ``shard`` (0 to shards - 1) and ``slot`` (gapless from 0 in its shard).

    ``key`` is an integer column, ``size`` a positive integer one. Null keys sort before all; repeated rows are
    separate records, and a key that alone overfills its range is spread by row. Columns named ``shard`` or ``slot``
    are replaced, all others carried along. An empty table gives an empty result; a null size counts as 0 bytes.
    The rows are written once to the shared folder, which fixes their number for the later steps, so pass only
    the columns that the result needs.
    """
    spark = records.sparkSession
    carried = [c for c in records.columns if c not in ("shard", "slot")]
    rows = stage(records.select(*carried).withColumn("_row", F.monotonically_increasing_id()), "shards")
    weight = "_bytes"
    rows = rows.withColumn(weight, F.coalesce(F.col(size).cast("long"), F.lit(0)))
    total = rows.agg(F.sum(weight)).first()[0] or 0
    ranges = shards * ranges_per_shard
    rows = rows.withColumn("_range", _range_of(F.col(key), _splitters(rows, key, weight, total, ranges)))

    # Ranges over twice their share are subdivided by row: at most ``ranges`` parts more in all.
    share = max(1, total // ranges)
    found = rows.groupBy("_range").agg(F.sum(weight).alias("b")).where(F.col("b") > 2 * share).collect()
    cuts = {r["_range"]: int(r["b"] // share) for r in found}
    parts = F.lit(1)
    if cuts:
        parts = F.coalesce(F.get(F.from_json(F.lit(str([cuts.get(i, 1) for i in range(max(cuts) + 1)])), "array<int>"), F.col("_range")), F.lit(1))
    rows = rows.withColumn("_part", F.pmod(F.xxhash64("_row"), parts).cast("int"))

    pieces = rows.groupBy("_range", "_part").agg(F.sum(weight).alias("b"), F.count("*").alias("n"))
    pieces = sorted(tuple(r) for r in pieces.collect())
    placed = _place([(r, p, b) for r, p, b, _ in pieces], shards)
    start, filled = [], [0] * shards
    for s, (*_, n) in zip(placed, pieces, strict=True):
        start.append(filled[s])
        filled[s] += n
    plan = [(r, p, s, at) for (r, p, *_), s, at in zip(pieces, placed, start, strict=True)]
    plan = spark.createDataFrame(plan, "_range int, _part int, shard int, _start long")  # at most 2 * ranges rows
    number = F.row_number().over(Window.partitionBy("_range", "_part").orderBy(F.col(key).asc_nulls_first(), "_row"))
    rows = rows.withColumn("_number", number).join(F.broadcast(plan), ["_range", "_part"])
    return rows.select(*carried, "shard", (F.col("_start") + F.col("_number") - 1).alias("slot"))
