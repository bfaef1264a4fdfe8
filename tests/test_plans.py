"""Plan shapes that matter when one key holds a large share of the rows."""

import pytest
from pyspark.sql import functions as F

from marklake.operators import captures, ids, media


@pytest.fixture
def merge_joins(spark):
    """Plans as they are when no side is small enough to broadcast."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_merging_after_a_join_is_spread_by_part(spark, merge_joins):
    rows = spark.range(10).select(
        (F.col("id") % 3).cast("string").alias("conv_id"), F.col("id").cast("int").alias("capture_no"), F.lit("{}").alias("raw")
    )
    wanted = rows.select("conv_id").distinct()
    text = plan(captures.merge_capture_pages(rows.join(wanted, "conv_id", "left_semi"), captures_per_part=2))
    assert "REPARTITION_BY_COL" in text
    assert captures.merge_capture_pages(rows, captures_per_part=2).count() == 10


def test_location_lists_are_spread_by_list(spark, merge_joins):
    rows = spark.range(10).select(F.lit("hot").alias("tweet_id"), F.col("id").alias("media_pos"), F.lit("x").alias("location"))
    text = plan(media.stored_locations(rows, per_list=2))
    assert text.count("Exchange hashpartitioning(") == 1 and "Join" not in text
    assert media.stored_locations(rows, per_list=2).count() == 5


def test_listed_documents_are_parsed_after_the_join(spark, merge_joins):
    rows = spark.createDataFrame([("1", "{}")], "conv_id string, raw string")
    text = plan(media.media_of_listed(rows, spark.createDataFrame([("1",)], "tweet_id string")))
    assert text.index("from_json") < text.index("LeftSemi"), "the join must stand below the parse"


def test_repeated_ids_shrink_before_the_join(spark, merge_joins):
    listed = spark.range(10).select(F.lit("1").alias("tweet_id"))
    ledger = spark.range(3).select(F.col("id").cast("string").alias("tweet_id"))
    text = plan(ids.find_pending(listed, ledger))
    join, aggregate = text.index("LeftAnti"), text.index("HashAggregate")
    assert join < aggregate, "the aggregate must stand below the join"


def test_ledger_lookup_is_pushed_down(spark, tmp_path):
    from marklake.sources.files import read_ledger

    path = str(tmp_path / "ledger")
    spark.createDataFrame([("1", None)], "tweet_id string, created_at timestamp").write.parquet(path)
    text = plan(read_ledger(spark, path, "1").select("tweet_id"))
    assert "EqualTo(tweet_id,1)" in text and "ReadSchema: struct<tweet_id:string>" in text


def test_listing_objects_reads_no_content(spark, tmp_path):
    from marklake.sources.files import list_objects

    (tmp_path / "a").write_bytes(b"x")
    assert "ReadSchema: struct<path:string,length:bigint>" in plan(list_objects(spark, str(tmp_path)))
