"""A live circuit breaker: sources are stopped while the run goes on.

Attempts arrive as a stream. After each micro-batch the length of every source's open run of failures is kept in a table, and
the next batch goes on from there, so the stops are those of the batch operator over all attempts, however they are
split into batches. The batch operator's stretches keep a source with very many attempts from one task.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from marklake.operators.attempts import failure_streaks, open_failures
from marklake.sinks.runs import newest, read_runs, run_number, write_run
from marklake.storage import stage


def watch_failures(
    attempts: DataFrame,
    state_dir: str,
    checkpoint: str,
    *,
    n: int = 50,
    order: tuple[str, ...] = ("seq",),
    stretch: str | None = None,
    name: str | None = None,
) -> StreamingQuery:
    """Write the stops of a stream of ``attempts(source, <order..>, ok, ..)`` to ``state_dir`` and end when all is read.

    A batch must hold later attempts of a source than the ones before it. Of a source that is stopped the attempts that
    still come are counted on, as the batch operator does; ``stretch`` is an expression for its stretches. A replayed batch
    rewrites its own rows.
    """
    stream = name or hashlib.sha256(checkpoint.rstrip("/").encode()).hexdigest()[:12]

    def watch(batch: DataFrame, batch_id: int) -> None:
        spark, run_id = batch.sparkSession, f"stream-{stream}-{batch_id:09d}"
        number = run_number(spark, state_dir, run_id)
        earlier = read_runs(spark, state_dir, "open_failures", without_run=run_id)
        if earlier is not None:
            # A replay must not see what later batches left.
            earlier = newest(earlier.where(F.col("run_number") < number), "source").select("source", "failures")
        rows = stage(batch, "attempts")
        cut = None if stretch is None else F.expr(stretch)
        write_run(failure_streaks(rows, n, order, cut, earlier), state_dir, "stops", run_id, number)
        write_run(open_failures(rows, order, cut, earlier), state_dir, "open_failures", run_id, number)

    return (
        attempts.writeStream.foreachBatch(watch)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def stops(spark: SparkSession, state_dir: str) -> DataFrame | None:
    """The attempts at which sources were stopped, over all batches; None before the first one."""
    rows = read_runs(spark, state_dir, "stops")
    return None if rows is None else rows.drop("run", "run_number")


def without_stopped(work: DataFrame, stopped: DataFrame) -> DataFrame:
    """Rows of ``work(source, ..)`` whose source was not stopped."""
    sources = stopped.select(F.col("source").alias("_stopped")).distinct()
    return work.join(sources, F.col("source").eqNullSafe(F.col("_stopped")), "left_anti")
