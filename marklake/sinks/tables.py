"""Writers: upserts, ledger, conversation documents, dated dumps."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marklake.sources.files import _exists, read_ledger


def _last_per_key(updates: DataFrame, key: str, order: str | None) -> DataFrame:
    """The last row of each key. An aggregate, so repeats shrink before the shuffle.

    Without ``order`` nothing tells which of several rows is the last: they fail.
    Of rows with the same ``order`` the one with the greater JSON text counts.
    """
    if order is None:
        rest = [c for c in updates.columns if c != key]
        one = F.first(F.struct(*rest)) if rest else F.first(key)
        fail = F.raise_error(F.lit(f"several updates of one {key} need an order"))
        once = F.when(F.count("*") > 1, fail).otherwise(one).alias("last")
        return updates.groupBy(key).agg(once).select(key, *(["last.*"] if rest else []))
    rest = [c for c in updates.columns if c not in (key, order)]
    content = F.struct(*rest) if rest else F.struct(key)
    return updates.groupBy(key).agg(
        F.max_by(content, F.struct(order, F.to_json(content))).alias("last")
    ).select(key, *(["last.*"] if rest else []))


def upsert_documents(
    target: DataFrame, updates: DataFrame, key: str, order: str | None = None
) -> DataFrame:
    """Rows of ``target`` with those of ``updates`` put in whole, by key.

    ``order`` names an extra column of ``updates`` that tells which of several
    rows of a key is the last.
    """
    last = _last_per_key(updates, key, order)
    kept = target.join(last.select(key), key, "left_anti")
    return kept.unionByName(last.select(*target.columns))


def upsert_raw(
    target: DataFrame, updates: DataFrame, key: str, order: str | None = None
) -> DataFrame:
    """Merge JSON documents by their top-level fields: ``key, doc map<string,variant>``.

    A field of the update replaces the stored one; stored fields the update
    does not carry survive. A document without fields is kept as such. Of values
    of a field with the same ``order`` the one with the greater JSON text counts.
    """
    if order is None:
        updates = _last_per_key(updates.select(key, "doc"), key, None)
    else:
        # One row per (key, field), the last value of each, before any map is built.
        fields = updates.select(key, order, F.explode_outer("doc").alias("field", "value"))
        held = F.when(F.col("field").isNotNull(), F.struct("field", "value"))
        updates = (
            fields.groupBy(key, "field")
            .agg(F.max_by("value", F.struct(order, F.to_json("value"))).alias("value"))
            .groupBy(key)
            .agg(F.map_from_entries(F.collect_list(held)).alias("doc"))
        )
    new = updates.select(key, F.col("doc").alias("new"))
    joined = target.select(key, F.col("doc").alias("old")).join(new, key, "full")
    surviving = F.map_filter(
        "old", lambda k, _: ~F.array_contains(F.map_keys("new"), k)
    )
    merged = F.when(F.col("new").isNull(), F.col("old")).when(
        F.col("old").isNull(), F.col("new")
    ).otherwise(F.map_concat(surviving, "new"))
    return joined.select(key, merged.alias("doc"))


def parse_document(raw: Column) -> Column:
    """JSON object text as the field map that :func:`upsert_raw` works on."""
    return F.from_json(raw, "map<string,variant>")


def upsert_action_counts(
    target: DataFrame, updates: DataFrame, key: str, by_id: bool = False
) -> DataFrame:
    """How an upsert acts: counts of ``inserted``, ``updated`` and ``unchanged``.

    ``by_id`` labels every update instead (``key, action``). Older logs call
    unchanged rows inserted too: add the two for that count.
    """
    rest = [c for c in target.columns if c != key]
    text = lambda df: df.select(key, F.to_json(F.struct(*rest)).alias("text"))
    old = text(target).withColumnRenamed("text", "old")
    labelled = (
        text(updates.select(*target.columns))
        .join(old, key, "left")
        .select(
            key,
            F.when(F.col("old").isNull(), "inserted")
            .when(F.col("old") == F.col("text"), "unchanged")
            .otherwise("updated")
            .alias("action"),
        )
    )
    if by_id:
        return labelled
    return labelled.agg(
        *[
            F.count_if(F.col("action") == a).alias(a)
            for a in ("inserted", "updated", "unchanged")
        ]
    )


def ledger_rows(ids: DataFrame, now: datetime | None = None) -> DataFrame:
    """Ledger rows for ``ids``, each once."""
    stamp = F.current_timestamp() if now is None else F.lit(now).cast("timestamp")
    return ids.select("tweet_id").distinct().select("tweet_id", stamp.alias("created_at"))


def new_ledger_rows(ledger: DataFrame, ids: DataFrame, now: datetime | None = None) -> DataFrame:
    """Ledger rows for the ids it does not hold yet, each once."""
    return ledger_rows(ids, now).join(ledger.select("tweet_id"), "tweet_id", "left_anti")


def append_ledger(
    spark: SparkSession,
    path: str,
    ids: DataFrame,
    now: datetime | None = None,
    on_conflict: str = "skip",
) -> None:
    """Append ids with their time. ``on_conflict='error'`` raises on a repeated id and writes nothing."""
    if on_conflict not in ("skip", "error"):
        raise ValueError(f"on_conflict must be 'skip' or 'error', got {on_conflict!r}")
    ledger = read_ledger(spark, path)
    if on_conflict == "error":
        repeated = ids.groupBy("tweet_id").count().where("count > 1").select("tweet_id")
        known = ids.select("tweet_id").join(ledger, "tweet_id", "left_semi")
        if not repeated.unionByName(known).isEmpty():
            raise ValueError("ids already in the ledger or repeated in the batch")
    new_ledger_rows(ledger, ids, now).write.mode("append").parquet(path)


def write_conversations(documents: DataFrame, path: str, format: str = "json", compression: str | None = None) -> None:
    """Extracted conversations, one record per line (``json``) or as Parquet; ``compression`` as Spark's writers take it."""
    writer = documents.write.mode("overwrite")
    if compression is not None:
        writer = writer.option("compression", compression)
    if format == "json":
        writer.option("ignoreNullFields", False).json(path)
    elif format == "parquet":
        writer.parquet(path)
    else:
        raise ValueError(f"unknown format {format!r}")


def write_snapshot(df: DataFrame, path: str, run_ts: str | None = None) -> str:
    """Dump as JSON lines: below ``run_ts=..`` when given, else replacing what is there."""
    target = f"{path}/run_ts={run_ts}" if run_ts else path
    df.write.mode("overwrite").json(target)
    return target
