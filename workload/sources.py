"""Queries over readers and dumps: files are written from the base tables and read back by the reader under test."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marklake.functions.scalars import short_id
from marklake.operators import bookmark_tree, ids
from marklake.operators.conversations import extract_conversations
from marklake.sinks import files as single_files
from marklake.sinks import tables
from marklake.sources import files
from workload.core import capture_rows
from workload.registry import query, work_dir
from workload.shapes import table
from workload.storage import _bookmark_files, _TREE


def write_files(rows: DataFrame, root: str) -> None:
    """A file below ``root`` for each row of ``rows(name, value)``."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = single_files.file_system(root)
        for batch in batches:
            for name, value in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                path = f"{base}/{name}"
                fs.create_dir(path.rsplit("/", 1)[0], recursive=True)
                with fs.open_output_stream(path) as out:
                    out.write(value.encode())
            yield pa.RecordBatch.from_pydict({"n": pa.array([batch.num_rows], type=pa.int64())})

    rows.select("name", "value").mapInArrow(write, "n long").agg(F.sum("n")).first()


_SAVED = "SELECT user_id, CAST(event_id AS VARCHAR) AS tweet_id FROM events WHERE event_type <> 'error'"


def _export(spark, sf_dir, name):
    """An export file for each user: a page for every hundred events, several lines long."""
    state = work_dir(spark, name)
    kind = F.when(F.col("event_type") == "error", "cursor-").otherwise("tweet-")
    one = F.concat(F.lit('{"entryId":"'), kind, F.col("event_id").cast("string"), F.lit('"}'))
    pages = table(spark, sf_dir, "events").groupBy("user_id", F.expr("event_id div 100").alias("page")).agg(F.array_join(F.collect_list(one), ",\n").alias("entries"))
    opening = '{"data":{"bookmark_timeline_v2":{"timeline":{"instructions":[{"entries":['
    page = F.concat(F.lit(opening), "entries", F.lit("]}]}}}}"))
    exports = pages.groupBy("user_id").agg(F.concat(F.lit("[\n"), F.array_join(F.collect_list(page), ",\n"), F.lit("\n]\n")).alias("value"))
    write_files(exports.select(F.concat("user_id", F.lit(".json")).alias("name"), "value"), state)
    return state


def _saved(pages):
    user = F.regexp_extract("file", r"([^/]+)\.json$", 1).cast("bigint")
    return ids.extract_saved_ids(pages).select(user.alias("user_id"), "tweet_id")


@query("read_pages", _SAVED)
def read_pages(spark, sf_dir):
    return _saved(files.read_bookmark_pages(spark, _export(spark, sf_dir, "pages")))


@query("read_pages_large", _SAVED)
def read_pages_large(spark, sf_dir):
    """The same by the reader that splits files."""
    return _saved(files.read_bookmark_pages(spark, _export(spark, sf_dir, "pages"), large=True))


_TURNS = """SELECT CAST(conv_id AS VARCHAR) AS conv_id, max(CASE WHEN turn = 0 THEN text END) AS main_text, count(*) - 1 AS n_replies
            FROM conversations GROUP BY conv_id"""


@query("read_conversations", _TURNS)
def read_conversations(spark, sf_dir):
    """A raw document for each conversation, in a file of its own."""
    state = work_dir(spark, "conversations")
    raw = capture_rows(spark, sf_dir, per_capture=1 << 30)
    # A capture wraps the document in {"data":..}.
    value = F.substring("raw", F.lit(9), F.length("raw") - 9)
    write_files(raw.select(F.concat("conv_id", F.lit(".json")).alias("name"), value.alias("value")), state)
    found = extract_conversations(files.read_conversations(spark, state))
    return found.select("conv_id", F.col("main_tweet.text").alias("main_text"), F.size("replies").cast("bigint").alias("n_replies"))


@query("conversation_files", _TURNS)
def conversation_files(spark, sf_dir):
    """Extracted conversations written as a file each and read back."""
    state = work_dir(spark, "files")
    value = F.substring("raw", F.lit(9), F.length("raw") - 9)
    raw = capture_rows(spark, sf_dir, per_capture=1 << 30).select("conv_id", value.alias("raw"))
    single_files.write_conversation_files(extract_conversations(raw), state)
    found = single_files.read_conversation_files(spark, state)
    parsed = F.from_json("value", "struct<conv_id:string,main_tweet:struct<text:string>,replies:array<string>>")
    found = found.where("part = 0").select("conv_id", parsed.alias("d"))
    return found.where("conv_id = d.conv_id").select("conv_id", F.col("d.main_tweet.text").alias("main_text"), F.size("d.replies").cast("bigint").alias("n_replies"))


@query("read_bookmarks", f"SELECT name, url, folder, date_added, folder_path FROM ({_TREE})")
def read_bookmarks(spark, sf_dir):
    """Bookmark files below profile folders, beside snapshots that don't count."""
    state = work_dir(spark, "bookmarks")
    trees = _bookmark_files(spark, sf_dir).select(F.regexp_replace("file", "[^A-Za-z0-9/]", "_").alias("file"), F.col("raw").alias("value"))
    profiles = trees.select(F.concat("file", F.lit("/Bookmarks")).alias("name"), "value")
    snapshots = trees.select(F.concat(F.lit("Snapshots/"), "file", F.lit("/Bookmarks")).alias("name"), "value")
    write_files(profiles.union(snapshots), state)
    found, _ = bookmark_tree.flatten_bookmark_tree(files.read_browser_bookmarks(spark, state, "Chrome"))
    date = F.col("date_added").cast("string").alias("date_added")
    return found.select("name", "url", "folder", date, F.array_join("folder_path", "/").alias("folder_path"))


@query("read_ids", "SELECT DISTINCT CAST(o_custkey AS BIGINT) AS tweet_id FROM orders")
def read_ids(spark, sf_dir):
    """Lists of the customers of each priority, with repeats."""
    state = work_dir(spark, "ids")
    one = F.concat(F.lit('"'), F.col("o_custkey").cast("string"), F.lit('"'))
    lists = table(spark, sf_dir, "orders").groupBy("o_orderpriority").agg(F.concat(F.lit("[\n"), F.array_join(F.collect_list(one), ",\n"), F.lit("\n]")).alias("value"))
    write_files(lists.select(F.concat("o_orderpriority", F.lit(".json")).alias("name"), "value"), state)
    return files.read_id_list(spark, state, as_integers=True)


@query(
    "read_ledger",
    "SELECT DISTINCT CAST(o_custkey AS VARCHAR) AS tweet_id, true AS in_time FROM orders",
)
def read_ledger(spark, sf_dir):
    """Two entries with overlap, stamped with the time of the call."""
    state = work_dir(spark, "ledger")
    customers = table(spark, sf_dir, "orders").select(F.col("o_custkey").cast("string").alias("tweet_id"), "o_orderstatus")
    tables.append_ledger(spark, f"{state}/ledger", customers.where("o_orderstatus <> 'F'"))
    tables.append_ledger(spark, f"{state}/ledger", customers)
    age = F.current_timestamp().cast("double") - F.col("created_at").cast("double")
    return files.read_ledger(spark, f"{state}/ledger").select("tweet_id", age.between(0, 3600).alias("in_time"))


@query(
    "snapshots",
    """SELECT user_id, CAST(event_id AS VARCHAR) AS tweet_id, CASE WHEN event_id % 2 = 0 THEN 'a' ELSE 'b' END AS run_ts
       FROM events WHERE event_type <> 'error'""",
)
def snapshots(spark, sf_dir):
    """Dumps of two runs; the second run is written twice."""
    state = work_dir(spark, "snapshots")
    events = table(spark, sf_dir, "events").where("event_type <> 'error'")
    rows = events.select("user_id", F.col("event_id").cast("string").alias("tweet_id"))
    even = F.col("tweet_id").cast("bigint") % 2 == 0
    tables.write_snapshot(rows.where(even), state, "a")
    tables.write_snapshot(rows, state, "b")
    tables.write_snapshot(rows.where(~even), state, "b")
    return spark.read.schema("user_id bigint, tweet_id string, run_ts string").json(state)


@query(
    "short_ids",
    """SELECT o_orderkey, sha256(o_orderkey || '#' || o_orderpriority || '#' || o_custkey)[1:8] AS id FROM orders""",
)
def short_ids(spark, sf_dir):
    parts = [F.col(c).cast("string") for c in ("o_orderkey", "o_orderpriority", "o_custkey")]
    return table(spark, sf_dir, "orders").select("o_orderkey", short_id(*parts).alias("id"))
