"""Saved ids: extraction from export pages, difference with the ledger, counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marklake.functions.text import split_part

# Where an export page keeps its entries and how saved posts are marked.
PAGE_DDL = (
    "struct<data:struct<bookmark_timeline_v2:struct<timeline:struct<"
    "instructions:array<struct<entries:array<struct<entryId:string>>>>>>>>"
)
SAVED_MARK = "tweet"


def extract_saved_ids(pages: DataFrame) -> DataFrame:
    """Ids on export pages: ``page_no.., entry_pos, tweet_id``; repeats are kept.

    ``pages(.., raw)``. A page is read up to its first broken entry (no entry
    id, or a saved post without an id part); ids before it stay, ids after it
    are dropped. Works inside the page row.
    """
    keys = [c for c in pages.columns if c != "raw"]
    entries = F.get(
        F.from_json("raw", PAGE_DDL)["data"]["bookmark_timeline_v2"]["timeline"]["instructions"],
        F.lit(0),
    )["entries"]

    def id_part(e):
        return split_part(e["entryId"], "-", 1)

    def readable(found):
        broken = F.array_position(
            F.transform(
                found,
                lambda e: e["entryId"].isNull()
                | (F.contains(e["entryId"], F.lit(SAVED_MARK)) & id_part(e).isNull()),
            ),
            True,
        )
        return F.when(broken == 0, found).otherwise(F.slice(found, 1, broken.cast("int") - 1))

    usable = F.get(F.transform(F.array(entries), readable), F.lit(0))
    return (
        pages.select(*keys, F.posexplode_outer(usable).alias("entry_pos", "entry"))
        .where(F.contains("entry.entryId", F.lit(SAVED_MARK)))
        .select(*keys, "entry_pos", id_part(F.col("entry")).alias("tweet_id"))
    )


def distinct_ids(ids: DataFrame) -> DataFrame:
    return ids.select("tweet_id").distinct()


def find_pending(ids: DataFrame, ledger: DataFrame) -> DataFrame:
    """Saved ids not yet in the ledger, each once."""
    # Deduplicated first, so a repeated id is one row when it reaches the join.
    return distinct_ids(ids).join(ledger.select("tweet_id"), "tweet_id", "left_anti")


def pending_stats(ids: DataFrame, ledger: DataFrame) -> DataFrame:
    """One row: distinct saved ids, whole-ledger count, ids still pending."""
    # One aggregate over both lists; repeats shrink before the shuffle.
    both = ids.select("tweet_id", F.lit(1).alias("saved"), F.lit(0).alias("done")).unionByName(
        ledger.select("tweet_id", F.lit(0).alias("saved"), F.lit(1).alias("done"))
    )
    per_id = both.groupBy("tweet_id").agg(
        F.max("saved").alias("saved"), F.sum("done").alias("done")
    )
    return per_id.agg(
        F.count_if(F.col("saved") == 1).alias("total_tweets"),
        F.coalesce(F.sum("done"), F.lit(0)).alias("processed_tweets"),
        F.count_if((F.col("saved") == 1) & (F.col("done") == 0)).alias("pending_tweets"),
    )


def ledger_count(ledger: DataFrame) -> DataFrame:
    return ledger.agg(F.count("*").alias("n"))


def ordered_ids(ids: DataFrame) -> DataFrame:
    """Ids in processing order, which is the order of their text, not of their value."""
    return distinct_ids(ids).orderBy("tweet_id")


def skip_processed(inputs: DataFrame, outputs: DataFrame, key: str = "conv_id") -> DataFrame:
    """Inputs without a readable output; an output that is not JSON counts as missing.

    ``outputs(key, value)`` with the output's text in ``value``.
    """
    readable = outputs.where(F.try_parse_json("value").isNotNull()).select(key)
    return inputs.join(readable, key, "left_anti")
