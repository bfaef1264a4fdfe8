"""Readers: export pages, conversations, captures, id lists, ledger, bookmark files, object listings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marklake.sources.arrays import read_array_elements
from marklake.sources.listing import list_files, local_starts, read_whole

LEDGER_DDL = "tweet_id string, created_at timestamp"

# Browsers whose bookmark files are understood.
BROWSERS = ("chrome", "edge", "brave")


def _exists(spark: SparkSession, path: str) -> bool:
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    return jvm_path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(jvm_path)


def _whole_files(spark: SparkSession, path: str, **options) -> DataFrame:
    # An argument, not an option: the argument's default would override the option.
    return spark.read.options(**options).text(path, wholetext=True).select("value", F.col("_metadata.file_path").alias("file"))


def read_bookmark_pages(spark: SparkSession, path: str, large: bool = False) -> DataFrame:
    """Export pages: ``file, page_no, raw``. Each ``*.json`` file is an array of pages.

    A file is one row on its way, which ends at 2 GB. With ``large`` files are read in splits, in two passes, and may be of
    any size; the rows are the same.
    """
    if large:
        elements = read_array_elements(spark, path, pathGlobFilter="*.json")
        return elements.withColumnRenamed("pos", "page_no")
    files = _whole_files(spark, path, pathGlobFilter="*.json")
    return files.select(
        "file", F.posexplode(F.from_json("value", "array<string>")).alias("page_no", "raw")
    )


def read_conversations(spark: SparkSession, path: str, format: str = "files") -> DataFrame:
    """Raw conversations: ``conv_id, raw``.

    ``files``: one document per ``*.json`` file directly in ``path``, its name
    without suffix being the id. ``ndjson``: lines of ``{"conv_id", "raw"}``.
    ``parquet``: a table with those columns; the format to use at scale.
    """
    if format == "files":
        files = _whole_files(spark, path, pathGlobFilter="*.json", recursiveFileLookup=False)
        # The path is a URI, in which a plus sign stands for itself.
        name = F.url_decode(F.replace(F.substring_index("file", "/", -1), F.lit("+"), F.lit("%2B")))
        return files.select(
            F.regexp_replace(name, r"\.json$", "").alias("conv_id"), F.col("value").alias("raw")
        )
    if format == "ndjson":
        return spark.read.schema("conv_id string, raw string").json(path)
    if format == "parquet":
        return spark.read.parquet(path)
    raise ValueError(f"unknown format {format!r}")


def read_captures(spark: SparkSession, path: str) -> DataFrame:
    """Captured responses from lines of ``{"conv_id", "capture_no", "raw"}``."""
    return spark.read.schema("conv_id string, capture_no int, raw string").json(path)


def read_id_list(spark: SparkSession, path: str, as_integers: bool = False) -> DataFrame:
    """Distinct ids of JSON array files; ``as_integers`` casts them, failing on other text.

    A file that is not JSON is an error, unlike an unreadable document: the
    list decides what a run works on.
    """
    files = _whole_files(spark, path)
    parsed = F.from_json("value", "array<string>", {"mode": "FAILFAST"})
    ids = files.select(F.explode(parsed).alias("tweet_id"))
    if as_integers:
        ids = ids.select(F.col("tweet_id").cast("bigint").alias("tweet_id"))
    return ids.distinct()


def read_ledger(spark: SparkSession, path: str, tweet_id: str | None = None) -> DataFrame:
    """Processed ids ``tweet_id, created_at``; no rows when there is no ledger yet."""
    if not _exists(spark, path):
        return spark.createDataFrame([], LEDGER_DDL)
    ledger = spark.read.schema(LEDGER_DDL).parquet(path).select("tweet_id", "created_at")
    return ledger if tweet_id is None else ledger.where(F.col("tweet_id") == tweet_id)


def read_browser_bookmarks(spark: SparkSession, root: str, browser: str) -> DataFrame:
    """Bookmark files below ``root``: ``browser, file, raw``.

    Takes every file whose name ends in ``Bookmarks``, in all profiles, except
    below or in anything called ``Snapshot``. Raises when there is none.
    """
    label = browser.lower()
    if label not in BROWSERS:
        raise ValueError(f"unsupported browser: {browser}")
    starts = local_starts(spark, root)
    if starts is None:
        found = _whole_files(spark, root, pathGlobFilter="*Bookmarks", recursiveFileLookup=True)
        found = found.where(~F.contains("file", F.lit("Snapshot")))
        none = found.isEmpty()
    else:
        # Files are listed and opened by tasks: profiles are many small folders.
        listed = list_files(spark, starts).where(F.col("path").endswith("Bookmarks") & ~F.contains("path", F.lit("Snapshot")))
        none, found = listed.isEmpty(), read_whole(listed)
    if none:
        raise ValueError(f"no bookmark files found below {root}")
    return found.select(F.lit(label).alias("browser"), "file", F.col("value").alias("raw"))


def list_objects(spark: SparkSession, root: str) -> DataFrame:
    """Stored objects ``key, length``; lists names and sizes only, no content is read.

    Local and mounted folders are listed by tasks, into a staged table; on other file systems Spark's listing is used, which
    holds the names on the driver.
    """
    base = spark._jvm.org.apache.hadoop.fs.Path(root)
    base = base.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(base).toString()
    starts = local_starts(spark, root)
    if starts is None:
        listed = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    else:
        listed = list_files(spark, starts)
    return listed.select(
        F.substring(F.col("path"), F.length(F.lit(base)) + 2, F.lit(2147483647)).alias("key"), "length"
    )
