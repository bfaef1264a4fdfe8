"""From raw documents to packed training sequences, stage by stage.

Every stage takes ``(spark, docs, sf_dir)`` and works on all that the one before it kept; its result is written as
Parquet and read again as the next one's documents. All but the last return the columns of documents; ``n_chars``
follows the text.

All stages: extra columns of the input, whatever their names, are dropped; an empty table gives an empty one; texts of any
length are worked on whole; rows with a null id are kept and sort first.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marklake.llm import mixing, orderminhash, packing, quality, substring
from marklake.storage import stage

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")

#: Near-duplicate groups, tilted rates and best-fit packing aren't SQL; tests compare each stage with brute force.
ORACLE_SQL = None


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass, without the lines that too many documents of their source share.

    A null text has no words and is rejected; a null source is a source of its own; repeated rows share their verdict, and
    texts of a source that are equal count once for a line's frequency.
    """
    kept = quality.judge_documents(docs, carry=("text", "lang", "source", "n_chars")).where("kept")
    text = quality.without_lines(F.col("text"), F.col("lost"))
    changed = F.when(F.col("lost").isNotNull(), F.length(text).cast("long")).otherwise(F.col("n_chars"))
    return kept.select("doc_id", text.alias("text"), "lang", "source", changed.alias("n_chars"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group, that of the least id.

    A null text counts as empty, and all empty texts are one group; rows without an id are in no group and stay; of rows that
    repeat id and text one is kept, either one where they differ in other columns.
    """
    return orderminhash.first_of_group(docs.select(*COLUMNS))


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without passages that occur earlier. Texts that lose nothing stay as they are.

    Earlier is the smaller id, of equal ids the smaller hash of the text. A null text loses nothing; rows that repeat id
    and text are one document and all keep the same.
    """
    found = substring.remove_repeats(docs).where("n_removed > 0").select(F.col("doc").alias("r_doc"), "tie", "kept_text")
    tie = F.coalesce(F.xxhash64("text"), F.lit(0))
    rows = docs.select(*COLUMNS, tie.alias("_tie"))
    both = rows.join(found.dropDuplicates(["r_doc", "tie"]), rows["doc_id"].eqNullSafe(F.col("r_doc")) & (F.col("_tie") == F.col("tie")), "left")
    changed = F.when(F.col("kept_text").isNotNull(), F.length("kept_text").cast("long")).otherwise(F.col("n_chars"))
    return both.select("doc_id", F.coalesce("kept_text", "text").alias("text"), "lang", "source", changed.alias("n_chars"))


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix takes it.

    A null source is the last one; a null text or one without words is taken once; repeated rows are drawn alike.
    """
    mixed = mixing.mix(docs, carry=("text", "lang", "n_chars"))
    copies = F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))
    return mixed.where("copies > 0").withColumn("_copy", copies).select(*COLUMNS)


def sequence_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents and their places in sequences of 1024 tokens.

    A null text is the end token alone; repeated rows are packed each; pieces of equal length may go in any order.
    """
    return packing.pack(packing.cut_documents(docs, public_tokenizers.path("byte_bpe_50k.json")))


STAGES = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("substring_dedup", substring_dedup),
    ("source_mixing", source_mixing),
    ("sequence_packing", sequence_packing),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows, over all documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, function in STAGES[:-1]:
        docs = stage(function(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
