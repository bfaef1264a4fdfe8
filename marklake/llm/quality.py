"""Quality rules of whole documents, and how often their lines occur across the documents of a host.

Base rules look at one text. The cross-document rule hashes normalised lines, counts the distinct documents of each
host that hold a line, removes lines over the limit and rejects documents that lose too much. Only DataFrame functions
are used: everything inside one text is array work in its row, and only line hashes are shuffled, never texts.

Fixed results: a null text has no words and fails the base rules, as does an empty one; a null host is a host of its
own; repeated rows get the same verdict each; equal texts of one host count as one document, so that a document
isn't boilerplate because it was copied; extra columns, whatever their names, are carried or ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marklake.storage import stage

WHITE = "[\\x20\\x09-\\x0D]+"
WORD = "[^\\x20\\x09-\\x0D]"
WHITE_CHARACTERS = " \t\n\x0b\x0c\r"
SYMBOLS = "[#*$%&|<>]"
WINDOW = 8


@dataclass(frozen=True)
class Limits:
    """``line_share`` and ``line_documents``: a line is boilerplate in more than that part of a host's documents and
    in more than that many. ``lost_share``: the part of its words that a document may lose to them."""

    min_words: int = 20
    max_repeat_percent: int = 30
    line_share: float = 0.02
    line_documents: int = 10
    lost_share: float = 0.5


def words_of(text: Column) -> Column:
    bare = F.btrim(text, F.lit(WHITE_CHARACTERS))
    return F.when(F.length(bare) > 0, F.split(bare, WHITE)).otherwise(F.array().cast("array<string>"))


def _shift(values: Column, by: int) -> Column:
    return F.slice(values, by + 1, F.greatest(F.size(values) - by, F.lit(0)))


def _pairs(values: Column, by: int) -> Column:
    """Hashes of (entry, entry ``by`` places on), as many as there are such pairs."""
    both = F.zip_with(values, _shift(values, by), lambda a, b: F.xxhash64(a, b))
    return F.slice(both, 1, F.greatest(F.size(values) - by, F.lit(0)))


def with_base(docs: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """Adds ``n_words``, ``word_chars``, ``n_symbols``, ``n_dup_lines``, ``n_repeat_words`` and ``base_failed``.

    Windows of 8 words are compared as 64-bit hashes within one text: word hashes, then pairs, fours and eights.
    """
    lines = F.filter(F.split(F.coalesce("text", F.lit("")), "\n"), lambda line: F.rlike(line, F.lit(WORD)))
    df = docs.withColumns({"_words": words_of(F.coalesce("text", F.lit(""))), "_lines": lines})
    # One column each: an expression used more than once would be evaluated more than once.
    df = df.withColumn("_one", F.transform("_words", lambda w: F.xxhash64(w)))
    df = df.withColumn("_two", _pairs(F.col("_one"), 1)).withColumn("_four", _pairs(F.col("_two"), 2))
    df = df.withColumn("_eight", _pairs(F.col("_four"), 4))
    found_twice = F.size(F.array_distinct("_eight")) < F.size("_eight")
    # Only texts that repeat a window: sort (hash, place), keep equal neighbours, add up what their windows cover.
    numbered = F.transform("_eight", lambda h, i: F.struct(h.alias("h"), i.alias("i")))
    df = df.withColumn("_sorted", F.when(found_twice, F.sort_array(numbered)))
    same = lambda x, at: F.coalesce(F.get(F.col("_sorted"), at)["h"] == x["h"], F.lit(False))
    repeated = F.filter("_sorted", lambda x, at: same(x, at - 1) | same(x, at + 1))
    df = df.withColumn("_places", F.sort_array(F.transform(repeated, lambda x: x["i"])))
    covered = F.zip_with("_places", _shift(F.col("_places"), 1), lambda a, b: F.least(F.coalesce(b - a, F.lit(WINDOW)), F.lit(WINDOW)))
    n_repeat = F.coalesce(F.aggregate(covered, F.lit(0), lambda s, x: s + x), F.lit(0)).cast("long")
    found = {
        "n_words": F.size("_words").cast("long"),
        "word_chars": F.length(F.array_join("_words", "")).cast("long"),
        "n_symbols": F.regexp_count(F.coalesce("text", F.lit("")), F.lit(SYMBOLS)).cast("long"),
        "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
        "n_repeat_words": n_repeat,
    }
    # A generator of one row: filters on the counts stay above it instead of being spelled out again below.
    counts = F.inline(F.array(F.struct(*[c.alias(name) for name, c in found.items()])))
    df = df.select(*[F.col(c) for c in docs.columns if c not in found], counts)
    failed = (F.col("n_words") < limits.min_words) | (100 * F.col("n_repeat_words") > limits.max_repeat_percent * F.col("n_words"))
    return df.withColumn("base_failed", failed)


def line_hash(line: Column) -> Column:
    """Lines count as equal whatever their case and white space."""
    return F.xxhash64(F.lower(F.regexp_replace(F.btrim(line, F.lit(WHITE_CHARACTERS)), WHITE, " ")))


def _lines(docs: DataFrame, host: str, doc_id: str) -> DataFrame:
    """A row for each line with a word: ``line`` (hash) and its number of words."""
    parts = F.filter(F.split("text", "\n"), lambda x: F.rlike(x, F.lit(WORD)))
    words = lambda x: F.size(F.split(F.btrim(x, F.lit(WHITE_CHARACTERS)), WHITE))
    each = docs.select(F.col(doc_id).alias("doc"), F.col(host).alias("host"), F.xxhash64("text").alias("copy"), F.monotonically_increasing_id().alias("row"), parts.alias("parts"))
    line = F.explode(F.transform("parts", lambda x: F.struct(line_hash(x).alias("line"), words(x).alias("n"))))
    return each.select("doc", "host", "copy", "row", line.alias("x")).select("doc", "host", "copy", "row", "x.line", "x.n")


def frequent_lines(lines: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """``host``, ``line``: what more documents of the host hold than the limits allow.

    Documents are told apart first, then counted, so a line that all documents share is added up from parts.
    """
    counts = lines.select("host", "line", "copy").distinct().groupBy("host", "line").agg(F.count("*").alias("documents"))
    hosts = lines.select("host", "copy").distinct().groupBy("host").agg(F.count("*").alias("all"))
    hosts = hosts.withColumnRenamed("host", "h_host")
    counts = counts.where(F.col("documents") > limits.line_documents)
    both = counts.join(hosts, F.col("host").eqNullSafe(F.col("h_host")))
    return both.where(F.col("documents") > limits.line_share * F.col("all")).select("host", "line")


def line_verdicts(docs: DataFrame, host: str = "source", doc_id: str = "doc_id", limits: Limits = Limits()) -> DataFrame:
    """``v_doc``, ``v_host``, ``v_copy`` (hash of the text), ``n_lost`` words and the hashes of ``lost`` lines, for the
    documents that hold frequent lines."""
    lines = stage(_lines(docs, host, doc_id), "lines")
    often = frequent_lines(lines, limits).withColumnsRenamed({"host": "o_host", "line": "o_line"})
    hit = lines.join(often, (lines["line"] == F.col("o_line")) & lines["host"].eqNullSafe(F.col("o_host")))
    each = hit.groupBy("doc", "host", "copy", "row").agg(F.sum("n").alias("n_lost"), F.collect_set("line").alias("lost"))
    # Repeated rows have equal verdicts.
    one = each.groupBy(F.col("doc").alias("v_doc"), F.col("host").alias("v_host"), F.col("copy").alias("v_copy"))
    return one.agg(F.max("n_lost").alias("n_lost"), F.first("lost").alias("lost"))


def judge_documents(docs: DataFrame, carry: tuple[str, ...] = (), host: str = "source", doc_id: str = "doc_id", limits: Limits = Limits()) -> DataFrame:
    """``doc_id``, the base counts, ``base_failed``, ``n_lost``, ``lost`` (null: none), ``kept`` and the ``carry`` columns.

    Kept are documents that pass the base rules and keep, without frequent lines, ``min_words`` words and all but
    ``lost_share`` of them.
    """
    base = docs.select(doc_id, F.col(host).alias("_host"), F.xxhash64("text").alias("_copy"), "text", *[F.col(c).alias(f"_carried_{c}") for c in carry])
    base = with_base(base, limits).drop("text")
    seen = line_verdicts(docs, host, doc_id, limits)
    same = F.col(doc_id).eqNullSafe(F.col("v_doc")) & F.col("_host").eqNullSafe(F.col("v_host")) & (F.col("_copy") == F.col("v_copy"))
    both = base.join(seen, same, "left")
    gone = F.coalesce("n_lost", F.lit(0))
    kept = ~F.col("base_failed") & (gone <= limits.lost_share * F.col("n_words")) & (F.col("n_words") - gone >= limits.min_words)
    counts = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    return both.select(doc_id, *counts, gone.alias("n_lost"), "lost", kept.alias("kept"), *[F.col(f"_carried_{c}").alias(c) for c in carry])


def without_lines(text: Column, lost: Column) -> Column:
    """The text without the lines whose hashes are in ``lost`` (null: none)."""
    left = F.filter(F.split(text, "\n"), lambda x: ~(F.rlike(x, F.lit(WORD)) & F.array_contains(lost, line_hash(x))))
    return F.when(lost.isNull(), text).otherwise(F.array_join(left, "\n"))
