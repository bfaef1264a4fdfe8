"""Every driver query against its SQL, and the shape of the plans."""

import os

import pytest

import __spark_entry__ as entry_module

duckdb = pytest.importorskip("duckdb")
SMALL = "/root/testdata/sf0.001"
TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()

pytestmark = pytest.mark.skipif(not os.path.isdir(SMALL), reason="no test tables")


@pytest.fixture(scope="module")
def oracle():
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SMALL}/{name}.parquet'")
    return con


def tidy(rows):
    return sorted((tuple(round(v, 6) if isinstance(v, float) else v for v in r) for r in rows), key=repr)


@pytest.fixture(scope="module")
def long_keys(spark, tmp_path_factory):
    """A conversation of 1,100 turns beside one of two, and a user with 1,100 events."""
    from pyspark.sql import functions as F

    path = str(tmp_path_factory.mktemp("long"))
    turn = F.col("id") % 1100
    spark.range(1102).select(
        F.when(F.col("id") < 1100, 1).otherwise(2).cast("bigint").alias("conv_id"), turn.alias("turn"),
        F.when(turn % 2 == 0, "user").otherwise("assistant").alias("role"), F.concat(F.lit("text "), turn.cast("string")).alias("text"),
    ).coalesce(1).write.parquet(f"{path}/conversations.parquet")
    events = spark.read.parquet(f"{SMALL}/events.parquet").limit(1100)
    events.withColumn("user_id", F.lit(7).cast(events.schema["user_id"].dataType)).coalesce(1).write.parquet(f"{path}/events.parquet")
    con = duckdb.connect()
    for name in ("conversations", "events"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}/{name}.parquet/*.parquet'")
    return path, con


LONG = ("two_mains", "assembled_documents", "merge_pages", "conversation_documents", "transcript", "stored_locations", "entries",
        "conversation_main", "post_variants", "media_stage")


@pytest.mark.parametrize("name", LONG)
def test_query_on_long_keys(spark, long_keys, name):
    path, con = long_keys
    compare(spark, con, name, path)


@pytest.mark.parametrize("name", sorted(entry_module.oracle_sql()))
def test_query(spark, oracle, name):
    compare(spark, oracle, name, SMALL)


def compare(spark, oracle, name, folder):
    df = entry_module.queries()[name](spark, folder)
    columns = sorted(df.columns)
    result = oracle.execute(entry_module.oracle_sql()[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == columns
    order = [names.index(c) for c in columns]
    want = tidy(tuple(r[i] for i in order) for r in result.fetchall())
    assert want, "the query must have something to find"
    assert tidy(df.select(*columns).collect()) == want


def test_entry(spark):
    assert entry_module.entry(spark).count() > 0


@pytest.mark.parametrize("name", ["posts_flat", "conversation_documents", "media_candidates", "transcript"])
def test_documents_are_parsed_once(spark, name):
    spark.conf.set("spark.sql.maxPlanStringLength", "100000000")
    spark.conf.set("spark.sql.debug.maxToStringFields", "10000")
    df = entry_module.queries()[name](spark, SMALL)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert plan.count("from_json(StructField(threaded_conversation") == 1
    assert "PythonUDF" not in plan and "CartesianProduct" not in plan and "NestedLoop" not in plan
