"""Captures arriving as files, ingested incrementally."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from marklake.plans.ingest import run_ingest

CAPTURE_DDL = "conv_id string, capture_no int, raw string"


def capture_stream(spark: SparkSession, path: str, files_per_batch: int | None = None) -> DataFrame:
    """Stream of capture rows from JSON-lines files dropped into ``path``.

    A batch takes all files that have arrived, unless ``files_per_batch`` is given.
    """
    reader = spark.readStream.schema(CAPTURE_DDL)
    if files_per_batch is not None:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.json(path)


def ingest_stream(
    captures: DataFrame,
    state_dir: str,
    checkpoint: str,
    *,
    pages: DataFrame | None = None,
    name: str | None = None,
    **options,
) -> StreamingQuery:
    """Run the ingest workflow on every micro-batch of ``captures`` and stop when all is read.

    The captures of a conversation may arrive in any number of batches: a batch extracts the conversations it touches
    from all their captures so far, and the newest extraction is the latest document. A capture that comes again under its
    number replaces the stored one. A batch that is replayed after a failure rewrites its own run and changes nothing
    else. With ``pages`` the captures of ids that aren't saved go to the ``late`` table (``late_captures``). Runs carry
    ``name``, by default a hash of the checkpoint's path, so streams with one state folder stay apart; a stream that
    starts over in the same place needs another name.
    """
    stream = name or hashlib.sha256(checkpoint.rstrip("/").encode()).hexdigest()[:12]

    def ingest(batch: DataFrame, batch_id: int) -> None:
        run_ingest(
            batch.sparkSession, pages, batch, state_dir, run_id=f"stream-{stream}-{batch_id:09d}", **options
        )

    return (
        captures.writeStream.foreachBatch(ingest)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
