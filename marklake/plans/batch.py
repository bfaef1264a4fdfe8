"""Batch extraction over many raw documents."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marklake.functions.text import KEEP
from marklake.operators.attempts import batch_summary
from marklake.operators.conversations import conversations_from_resolved
from marklake.operators.documents import resolve_documents
from marklake.session import check_session
from marklake.sinks.tables import write_conversations
from marklake.sources.files import _exists
from marklake.storage import stage

MANIFEST_DDL = "conv_id string, file string, length bigint, modified timestamp"
#: Changed files whose names are listed one by one; beyond it the whole folder is read and joined with them.
MOST_LISTED = 10_000


@dataclass(frozen=True)
class BatchResult:
    """All three read the written run, so none of them extracts again."""

    documents: DataFrame
    failures: DataFrame
    summary: DataFrame


def _document_files(spark: SparkSession, output: str) -> DataFrame:
    """``file, length, modified`` of the written documents; a listing, no content is read."""
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "part-*").load(f"{output}/documents")
    file = F.regexp_extract("path", "([^/]+/[^/]+)$", 1)
    return listed.select(file.alias("file"), "length", F.col("modificationTime").alias("modified"))


def _lines(spark: SparkSession, output: str, files: DataFrame) -> DataFrame:
    """``value, file``: the lines of ``files``."""
    names = [r["file"] for r in files.select("file").take(MOST_LISTED + 1)]
    if len(names) <= MOST_LISTED:  # the usual case: only these are opened
        lines = spark.read.text([f"{output}/documents/{name}" for name in names])
    else:
        lines = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "part-*").text(f"{output}/documents")
    file = F.regexp_extract(F.col("_metadata.file_path"), "([^/]+/[^/]+)$", 1)
    return lines.select("value", F.url_decode(F.replace(file, F.lit("+"), F.lit("%2B"))).alias("file"))


def _readable_ids(spark: SparkSession, output: str, files: DataFrame) -> DataFrame:
    """``conv_id`` of every readable line in ``files``."""
    lines = _lines(spark, output, files).where(F.try_parse_json("value").isNotNull())
    return lines.select(F.get_json_object("value", "$.conv_id").alias("conv_id"), "file").join(files.select("file"), "file", "left_semi").select("conv_id")


def _manifest(spark: SparkSession, output: str) -> DataFrame:
    if not _exists(spark, f"{output}/manifest"):
        return spark.createDataFrame([], f"{MANIFEST_DDL}, run string")
    # The run names are text even when they look like numbers or dates.
    return spark.read.schema(f"{MANIFEST_DDL}, run string").parquet(f"{output}/manifest")


def _valid(manifest: DataFrame, listed: DataFrame) -> DataFrame:
    """``run``: the entries all of whose files are as they were noted."""
    there = listed.withColumn("there", F.lit(True))
    noted = manifest.where("conv_id IS NULL").join(there, ["file", "length", "modified"], "left")
    return noted.groupBy("run").agg(F.count_if(F.col("there").isNull()).alias("gone")).where("gone = 0").select("run")


def finished_ids(spark: SparkSession, output: str, run_id: str) -> DataFrame | None:
    """Ids with a readable output written by other runs than ``run_id``; None when there is no output.

    An entry of the manifest holds the files that a run wrote, with length and time, and the ids in them. As long as its
    files are as noted the entry counts. Files without such an entry are read, and noted in an entry of this run.
    """
    if not _exists(spark, f"{output}/documents"):
        return None
    listed = _document_files(spark, output).where(~F.col("file").startswith(f"run={run_id}/"))
    manifest = _manifest(spark, output)
    covered = manifest.where("conv_id IS NULL").join(_valid(manifest, listed), "run", "left_semi").select("file")
    unknown = stage(listed.join(covered, "file", "left_anti"), "files")
    if not unknown.isEmpty():
        note_outputs(spark, output, f"~{run_id}", unknown, _readable_ids(spark, output, unknown))
        manifest = _manifest(spark, output)
    return manifest.where("conv_id IS NOT NULL").join(_valid(manifest, listed), "run", "left_semi").select("conv_id")


def note_outputs(spark: SparkSession, output: str, entry: str, files: DataFrame, ids: DataFrame) -> None:
    """Add an entry to the manifest: a row for each file, and one for each id in them.

    Bloom filters over the ids let a look-up of single ids skip most files of the manifest.
    """
    rows = files.select("file", "length", "modified").unionByName(ids.select("conv_id"), allowMissingColumns=True)
    writer = rows.select("conv_id", "file", "length", "modified").write.mode("overwrite")
    writer.option("parquet.bloom.filter.enabled#conv_id", "true").parquet(f"{output}/manifest/run={entry}")


def extract_batch(
    spark: SparkSession,
    conversations: DataFrame,
    output: str,
    run_id: str,
    *,
    with_media: bool = True,
    mode: str = KEEP,
    strict: bool = True,
    compression: str | None = None,
    **options,
) -> BatchResult:
    """Extract all documents that have no readable output yet.

    Documents go to ``{output}/documents/run=..`` as JSON lines, failed ones to
    ``{output}/failures/run=..``. A document that cannot be used never stops
    the run. Running again skips what other runs did and retries what failed;
    a run that is repeated under its own id writes its output anew. Which ids
    are done is read from a narrow manifest; of earlier output only files that
    changed since are read (:func:`finished_ids`).

    ``compression`` ('gzip', ..) is that of the JSON lines, plain text by default. Every field is written, null or not, so
    plain lines are several times as long as what they say.
    """
    check_session(spark)
    finished = finished_ids(spark, output, run_id)
    todo = conversations if finished is None else conversations.join(finished, "conv_id", "left_anti")
    built = conversations_from_resolved(
        resolve_documents(todo, strict=strict), mode, with_media=with_media, **options
    )
    # One pass over the raw text; documents and failures are split from the result.
    results = f"{output}/results/run={run_id}"
    built.write.mode("overwrite").option("compression", "zstd").parquet(results)
    written = spark.read.parquet(results)
    ok = F.col("stage").isNull()
    documents = written.where(ok).select("conv_id", "main_tweet", "replies")
    failures = written.where(~ok).select("conv_id", "stage", "reason")
    write_conversations(documents, f"{output}/documents/run={run_id}", compression=compression)
    failures.write.mode("overwrite").parquet(f"{output}/failures/run={run_id}")
    own = _document_files(spark, output).where(F.col("file").startswith(f"run={run_id}/"))
    note_outputs(spark, output, run_id, own, documents)
    attempts = written.select(F.col("conv_id").alias("tweet_id"), ok.alias("ok"))
    return BatchResult(documents, failures, batch_summary(attempts))
