"""Outcome of processing attempts: totals, failed ids, runs of failures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def batch_summary(attempts: DataFrame) -> DataFrame:
    """One row: how many attempts succeeded and how many failed. ``attempts(tweet_id, ok)``."""
    return attempts.agg(
        F.count_if(F.col("ok")).alias("processed"), F.count_if(~F.col("ok")).alias("failed")
    )


def failed_ids(attempts: DataFrame) -> DataFrame:
    """Ids of failed attempts as rows, so that the list may be of any length."""
    return attempts.where(~F.col("ok")).select("tweet_id")


def failure_streaks(
    attempts: DataFrame,
    n: int = 50,
    order: tuple[str, ...] = ("seq",),
    stretch: Column | None = None,
    before: DataFrame | None = None,
) -> DataFrame:
    """The attempts at which a source's run of consecutive failures reaches ``n``.

    ``attempts(source, <order..>, ok, ..)``. A success ends a run. One row per
    run that gets so long: where processing would have stopped. ``before(source,
    failures)``: how long each source's run already is, where these attempts go
    on from earlier ones (:func:`open_failures`).

    A source may hold a large share of all attempts, so no window spans a
    whole source. Attempts are cut into stretches (``stretch``: any value that
    never falls along the order; by default every 100,000 numbers of the first
    order column). A window numbers the runs inside each stretch; one summary
    row per stretch tells how long a run already was where the next one starts.
    """
    keys = list(order)
    runs = _islands(attempts, keys, stretch)
    numbered = runs.where(~F.col("ok")).withColumn(
        "_run", F.row_number().over(W.partitionBy("source", "_stretch", "_island").orderBy(*keys))
    )
    in_source = W.partitionBy("source").orderBy("_stretch")
    # The run that comes in: tails since the last stretch with a success, its own included.
    earlier = in_source.rowsBetween(W.unboundedPreceding, -1)
    so_far = _stretches(runs).select(
        "source",
        "_stretch",
        F.coalesce(F.sum("tail").over(earlier), F.lit(0)).alias("tails_before"),
        F.when(F.col("successes") > 0, True).alias("has_success"),
    )
    base = F.last(F.when(F.col("has_success"), F.col("tails_before")), ignorenulls=True).over(earlier)
    incoming = so_far.select("source", "_stretch", "tails_before", base.alias("base"))
    # Null sources and places are values like any other.
    at = incoming.select(
        F.col("source").alias("_source"),
        F.col("_stretch").alias("_of"),
        (F.col("tails_before") - F.coalesce("base", F.lit(0))).alias("_carry"),
        F.col("base").isNull().alias("_first"),
    )
    if before is not None:
        held = before.select(F.col("source").alias("_held_by"), F.col("failures").alias("_held"))
        at = at.join(held, F.col("_source").eqNullSafe(F.col("_held_by")), "left")
        at = at.withColumn("_carry", F.col("_carry") + F.when(F.col("_first"), F.coalesce("_held", F.lit(0))).otherwise(0))
    total = F.col("_run") + F.when(F.col("_island") == 0, F.col("_carry")).otherwise(0)
    same = F.col("source").eqNullSafe(F.col("_source")) & F.col("_stretch").eqNullSafe(F.col("_of"))
    return numbered.join(at, same).where(total == n).select(*attempts.columns)


def _islands(attempts: DataFrame, keys: list[str], stretch: Column | None) -> DataFrame:
    """Adds the attempt's stretch and the number of successes up to it in that stretch."""
    cut = F.expr(f"{keys[0]} div 100000") if stretch is None else stretch
    inside = W.partitionBy("source", "_stretch").orderBy(*keys)
    return attempts.withColumn("_stretch", cut).withColumn("_island", F.count_if("ok").over(inside))


def _stretches(runs: DataFrame) -> DataFrame:
    """Successes of each stretch, and the failures after the last of them."""
    return (
        runs.groupBy("source", "_stretch", "_island")
        .agg(F.count_if(~F.col("ok")).alias("fails"))
        .groupBy("source", "_stretch")
        .agg(F.max("_island").alias("successes"), F.max_by("fails", "_island").alias("tail"))
    )


def open_failures(
    attempts: DataFrame,
    order: tuple[str, ...] = ("seq",),
    stretch: Column | None = None,
    before: DataFrame | None = None,
) -> DataFrame:
    """``source, failures``: how long the run is that each source's attempts end with.

    With ``before`` (as in :func:`failure_streaks`) a source without a success goes on from there.
    """
    last = _stretches(_islands(attempts, list(order), stretch))
    ok = last.groupBy(F.col("source").alias("_s")).agg(F.max(F.when(F.col("successes") > 0, F.col("_stretch"))).alias("_ok"))
    both = last.join(ok, F.col("source").eqNullSafe(F.col("_s")))
    counts = both.groupBy("source").agg(
        F.sum(F.when(F.col("_ok").isNull() | (F.col("_stretch") >= F.col("_ok")), F.col("tail")).otherwise(0)).alias("failures"),
        F.max("_ok").isNull().alias("_whole"),
    )
    if before is None:
        return counts.drop("_whole")
    held = before.select(F.col("source").alias("_held_by"), F.col("failures").alias("_held"))
    counts = counts.join(held, F.col("source").eqNullSafe(F.col("_held_by")), "left")
    carried = F.when(F.col("_whole"), F.coalesce("_held", F.lit(0))).otherwise(0)
    return counts.select("source", (F.col("failures") + carried).alias("failures"))
