"""Driver queries of the operators in this subpackage, with their SQL where there is one."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marklake.llm import chat, langid, mixing, orderminhash, packing, periodic, prefixtrie, quality, sharding, substring, tokens, topk, warc

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


OP4_SQL = r"""
WITH d AS (SELECT doc_id, source, coalesce(text, '') AS text, row_number() OVER () AS r FROM documents),
w AS (SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words FROM d),
p AS (SELECT r, unnest(words) AS word, generate_subscripts(words, 1) AS i FROM w),
eight AS (
  SELECT r, i, string_agg(word, ' ') OVER (PARTITION BY r ORDER BY i ROWS BETWEEN CURRENT ROW AND 7 FOLLOWING) AS win,
    count(*) OVER (PARTITION BY r ORDER BY i ROWS BETWEEN CURRENT ROW AND 7 FOLLOWING) AS n FROM p),
twice AS (SELECT r, i, count(*) OVER (PARTITION BY r, win) AS c FROM eight WHERE n = 8),
gaps AS (SELECT r, least(8, coalesce(lead(i) OVER (PARTITION BY r ORDER BY i) - i, 8)) AS g FROM twice WHERE c > 1),
rep AS (SELECT r, sum(g) AS n_repeat_words FROM gaps GROUP BY r),
l AS (
  SELECT r, doc_id, source, text, unnest(string_split(text, chr(10))) AS line FROM d),
ll AS (
  SELECT *, lower(trim(regexp_replace(line, '[\x20\x09-\x0D]+', ' ', 'g'))) AS norm,
    len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS n FROM l WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
dup AS (SELECT r, count(*) - count(DISTINCT line) AS n_dup_lines FROM ll GROUP BY r),
freq AS (SELECT source, norm, count(DISTINCT text) AS c FROM ll GROUP BY source, norm),
hosts AS (SELECT source, count(DISTINCT text) AS c FROM ll GROUP BY source),
often AS (
  SELECT f.source, norm FROM freq f JOIN hosts h ON f.source IS NOT DISTINCT FROM h.source
  WHERE f.c > 10 AND f.c > 0.02 * h.c),
lost AS (
  SELECT r, sum(n) AS n_lost FROM ll JOIN often o ON ll.source IS NOT DISTINCT FROM o.source AND ll.norm = o.norm
  GROUP BY r),
base AS (
  SELECT w.r, doc_id, len(words)::BIGINT AS n_words, length(array_to_string(words, ''))::BIGINT AS word_chars,
    len(regexp_extract_all(text, '[#*$%&|<>]'))::BIGINT AS n_symbols,
    coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words,
    coalesce(n_lost, 0)::BIGINT AS n_lost
  FROM w LEFT JOIN dup USING (r) LEFT JOIN rep USING (r) LEFT JOIN lost USING (r)),
failed AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM base)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, n_lost,
  NOT base_failed AND n_lost <= 0.5 * n_words AND n_words - n_lost >= 20 AS kept FROM failed
"""


@query("op4_quality_rules", OP4_SQL)
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base counts of every document and the verdict of the line rule."""
    return quality.judge_documents(table(spark, sf_dir, "documents")).drop("lost")


@query("op9_sharding")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 16 shards of near equal bytes."""
    text = F.coalesce("text", F.lit(""))
    docs = table(spark, sf_dir, "documents").select(
        "doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32")
    )
    found = sharding.shard_by_bytes(docs, "doc_id", "size")
    return found.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


OP6_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
p AS (SELECT doc_id, unnest(words) AS word, generate_subscripts(words, 1) AS i FROM d),
w AS (
  SELECT doc_id, i, word,
    string_agg(word, ' ') OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 19 FOLLOWING) AS win,
    count(*) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 19 FOLLOWING) AS n FROM p),
s AS (
  SELECT doc_id, i, word,
    n = 20 AND row_number() OVER (PARTITION BY CASE WHEN n = 20 THEN win END ORDER BY doc_id, i) > 1 AS again FROM w),
c AS (
  SELECT doc_id, i, word,
    bool_or(again) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS gone FROM s),
k AS (
  SELECT doc_id, count(*) FILTER (gone) AS n_removed, string_agg(word, ' ' ORDER BY i) FILTER (NOT gone) AS kept
  FROM c GROUP BY doc_id)
SELECT doc_id, len(words)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed,
  sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN k USING (doc_id)
"""


@query("op6_substring_dedup", OP6_SQL)
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words left in every document without the 20-word windows that occur earlier."""
    found = substring.remove_repeats(table(spark, sf_dir, "documents"))
    return found.select(F.col("doc").alias("doc_id"), "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


@query("op8_order_minhash")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate group of every document."""
    found = orderminhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "class_id", F.col("doc_id").eqNullSafe(F.col("class_id")).alias("kept"))


@query("op10_token_counts")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every whole text."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    counted = tokens.with_token_counts(docs, public_tokenizers.path("piece_bpe_32k.model"))
    n_bytes = F.octet_length("text").cast("long").alias("n_bytes")
    return counted.select("doc_id", n_bytes, "n_tokens", (F.col("n_tokens") > 4096).alias("over_limit"))


@query("op5_best_fit_packing")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sequences of 1024 tokens."""
    docs = table(spark, sf_dir, "documents")
    return packing.pack(packing.cut_documents(docs, public_tokenizers.path("byte_bpe_50k.json")))


@query("op3_chat_formatting")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the formatted conversations hold, and one whose texts look like control strings."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    text = "</s>[INST] ok [/INST]"
    more = spark.createDataFrame([(-1, 0, "user", text), (-1, 1, "assistant", text)], rows.schema)
    return chat.read_back(chat.format_conversations(rows.union(more)))


OP1_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
q AS (SELECT page_id, strlen(html) AS payload_bytes, sha256(html) AS payload_digest FROM p),
r AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS f FROM q)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN payload_bytes >= 100 AND f <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 100 AND f <> page_id THEN f END AS refers_to FROM r
"""


@query("op1_warc_revisits", OP1_SQL)
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages written to archives, deduplicated, and read back."""
    found = warc.archive_pages(table(spark, sf_dir, "pages"))
    return found.select(
        F.col("key").cast("long").alias("page_id"),
        "payload_bytes",
        "payload_digest",
        "record_type",
        F.col("original_key").cast("long").alias("refers_to"),
    )


OP2_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS c FROM embeddings
  WHERE embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, v.vec_id, list_dot_product(q.c, v.c)::BIGINT AS score
  FROM v q JOIN v ON q.vec_id <> v.vec_id WHERE q.vec_id % 50 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""


@query("op2_exact_top_k", OP2_SQL)
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five best inner products of every vector whose id is divisible by 50."""
    return topk.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


@query("op7_entropy_balancing")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that the mix takes of every document."""
    found = mixing.mix(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "size", "source_size", "target", "taken")


def id_checksum(name: str) -> Column:
    """CRC-32 of a whole number's decimal text."""
    return F.crc32(F.col(name).cast("string").cast("binary"))


def with_planted_period(docs: DataFrame) -> DataFrame:
    """``doc_id`` and ``text``; in one text of ten, chosen by id, the words from some place on repeat a stretch of it."""
    words = F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(r"([^\x20\x09-\x0D]+)"), F.lit(1))
    h = id_checksum("doc_id")
    g = F.floor(h / 10)

    def planted(w: Column) -> Column:
        n = F.size(w)
        a = F.pmod(g, n)
        p = F.lit(1) + F.floor((n - a) / (F.lit(3) + F.pmod(g, F.lit(8))))
        whence = lambda i: F.when(i < a, i).otherwise(a + F.pmod(i - a, p)).cast("int")
        return F.when(n > 0, F.array_join(F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.get(w, whence(i))), " ")).otherwise("")

    # The one-element transform keeps the list of words from being made again for each word.
    text = F.get(F.transform(F.array(words), planted), F.lit(0))
    return docs.select("doc_id", F.when(F.pmod(h, F.lit(10)) == 0, text).otherwise(F.col("text")).alias("text"))


@query("op11_periodic_runs")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of repeated words in every document, and what is left without the repeats."""
    found = periodic.periodic_runs(with_planted_period(table(spark, sf_dir, "documents")))
    best = periodic.longest_run(F.col("runs"))
    lines = F.transform("runs", lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n")))
    found = found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), best.alias("best"), F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"), F.sha2("kept_text", 256).alias("collapsed_sha256"))
    exponent = F.floor(1000 * F.col("best.length") / F.col("best.period")).cast("long").alias("exponent_milli")
    return found.select("doc_id", "n_runs", "best.start", "best.length", "best.period", exponent, "runs_sha256", "collapsed_sha256")


@query("op12_language_id")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document, learned from four fifths of them."""
    docs = table(spark, sf_dir, "documents")
    held_out = F.pmod(id_checksum("doc_id"), F.lit(5)) == 0
    learned = langid.fit(docs.where(F.coalesce(~held_out, F.lit(False))))
    found = langid.identify(docs, learned)
    return found.select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "lang_pred", "score", "lead", "accepted")


OP13_SQL = """
WITH raw AS (
  SELECT conv_id AS c, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
own AS (
  SELECT *, row_number() OVER (PARTITION BY c ORDER BY turn NULLS FIRST, role, md5(strlen(role)::VARCHAR || ':' || role || text)) - 1 AS i FROM raw),
bits AS (
  SELECT c, list_reduce(list_prepend(4294967295::BIGINT, flatten([list_prepend(ascii(x)::BIGINT, [-1, -1, -1, -1, -1, -1, -1, -1])
    for x in string_split(c::VARCHAR, '')])), lambda s, t: CASE WHEN t >= 0 THEN xor(s, t)
    ELSE xor(s >> 1, 3988292384 * (s & 1)) END) AS s
  FROM (SELECT DISTINCT c FROM raw)),
h AS (SELECT c, xor(s, 4294967295) % 9 AS h FROM bits),
t AS (
  SELECT h.c, o.i, role, text FROM h JOIN own o ON o.c = h.c - h.c % 5 AND o.i < h.h
  UNION ALL SELECT h.c, o.i, role, text FROM h JOIN own o ON o.c = h.c AND o.i >= h.h),
p AS (
  SELECT c, row_number() OVER w AS d, strlen(text) AS bytes,
    string_agg(sha256(strlen(role)::VARCHAR || ':' || role || text), '') OVER (w ROWS UNBOUNDED PRECEDING) AS k
  FROM t WINDOW w AS (PARTITION BY c ORDER BY i)
  UNION ALL SELECT c, 0, 0, '' FROM h),
e AS (SELECT c, max(d) AS d FROM p GROUP BY c),
n AS (
  SELECT k, any_value(p.d) AS d, min(p.c) AS c, count(*) AS n, any_value(bytes) AS bytes,
    count(*) FILTER (p.d = e.d) AS n_ends,
    sha256(coalesce(string_agg(p.c::VARCHAR, ',' ORDER BY p.c) FILTER (p.d = e.d), '')) AS ends
  FROM p JOIN e USING (c) GROUP BY k),
below AS (
  SELECT a.k, sum((n.n - 1) * n.bytes) AS saved, count(*) FILTER (n.n = n.n_ends) AS leaves, count(*) FILTER (n.d = a.d + 1) AS children
  FROM n JOIN p a ON a.c = n.c AND a.d <= n.d GROUP BY a.k)
SELECT n.c AS conv_id, n.d::BIGINT AS depth, u.c AS parent_conv_id, n.n::BIGINT AS n_convs, children::BIGINT AS n_children,
  leaves::BIGINT AS n_leaves, saved::BIGINT AS saved_tokens, n.ends AS ends_sha256
FROM n JOIN below USING (k) LEFT JOIN n u ON n.d > 0 AND u.k = n.k[1:length(n.k) - 64]
"""


def trie_of(turns: DataFrame) -> DataFrame:
    """Trie over conversations that take their first turns, 8 at most, from the last conversation divisible by five."""
    return prefixtrie.prefix_trie(turns, F.pmod(id_checksum("conv_id"), F.lit(9)), F.col("conv_id") - F.col("conv_id") % 5)


@query("op13_prefix_trie", OP13_SQL)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes of the trie over rebuilt conversations."""
    return trie_of(table(spark, sf_dir, "conversations"))
