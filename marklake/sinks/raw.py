"""Raw documents as fields: one current document for each id, merged when it is read.

A document is kept as a row for each top-level field. Of a field that several runs wrote the newest value counts, and a field
that a later run does not carry survives: what an upsert with a merge of top-level keys comes to, without rewriting what
is stored.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marklake.sinks.runs import compact, read_runs, run_number, version, write_run

TABLE = "raw"


def document_fields(docs: DataFrame, *keys: str, order: str | None = None) -> DataFrame:
    """``keys.., field, value``: a row for each top-level field of ``docs(keys.., raw)``, the value as JSON text.

    A document without fields, or whose text isn't a JSON object, keeps one row with a null field. Of several rows of a key
    and field the one with the greatest ``order`` counts, of equal ones the greater text; without an order they fail.
    """
    parsed = docs.select(*keys, *([order] if order else []), F.explode_outer(F.from_json("raw", "map<string,variant>")).alias("field", "_value"))
    rows = parsed.withColumn("value", F.to_json("_value")).drop("_value")
    if order is None:
        fail = F.raise_error(F.lit("several values of one field need an order"))
        value = F.when((F.count("*") > 1) & F.first("field").isNotNull(), fail).otherwise(F.max("value"))
    else:
        value = F.max(F.struct(order, "value"))["value"]
    return rows.groupBy(*keys, "field").agg(value.alias("value"))


def append_documents(spark: SparkSession, state_dir: str, docs: DataFrame, run_id: str, keys: Sequence[str] = ("conv_id",), order: str | None = None) -> DataFrame:
    """Add ``docs(keys.., raw)`` as a run; the same ``run_id`` again replaces that run."""
    return write_run(document_fields(docs, *keys, order=order), state_dir, TABLE, run_id, run_number(spark, state_dir, run_id))


def current_fields(spark: SparkSession, state_dir: str, keys: Sequence[str] = ("conv_id",)) -> DataFrame:
    """``keys.., field, value``: the newest value of each field."""
    rows = read_runs(spark, state_dir, TABLE)
    if rows is None:
        raise ValueError(f"no raw documents below {state_dir}")
    return rows.groupBy(*keys, "field").agg(F.max_by("value", version()).alias("value"))


def current_documents(spark: SparkSession, state_dir: str, keys: Sequence[str] = ("conv_id",)) -> DataFrame:
    """``keys.., raw``: one document for each key, its fields by name."""
    fields = current_fields(spark, state_dir, keys)
    name = F.to_json(F.array("field"))
    pair = F.concat(F.substr(name, F.lit(2), F.length(name) - 2), F.lit(":"), F.coalesce("value", F.lit("null")))
    listed = F.array_sort(F.collect_list(F.when(F.col("field").isNotNull(), F.struct("field", pair.alias("pair")))))
    documents = fields.groupBy(*keys).agg(listed.alias("pairs"))
    text = F.array_join(F.transform("pairs", lambda p: p["pair"]), ",")
    return documents.select(*keys, F.concat(F.lit("{"), text, F.lit("}")).alias("raw"))


def compact_documents(spark: SparkSession, state_dir: str, keys: Sequence[str] = ("conv_id",)) -> int:
    """Write the current fields out once, so that readers needn't merge earlier runs again."""
    return compact(spark, state_dir, TABLE, *keys, "field")
