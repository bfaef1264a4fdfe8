"""Queries over media, sinks, attempts, bookmark trees and whole jobs."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Window
from pyspark.sql import functions as F

from marklake.operators import attempts, bookmark_tree, fetch, media as media_ops, posts
from marklake.model import ROOT_KEY
from marklake.plans import batch, ingest
from marklake.plans.media import run_media
from marklake.plans.workflow import run_workflow
from marklake.sinks import raw, tables
from marklake.sinks.files import FolderSink
from marklake.sources.files import list_objects
from marklake.streaming import breaker
from marklake.streaming.ingest import capture_stream, ingest_stream
from workload.core import capture_rows
from workload.registry import query, work_dir, written
from workload.shapes import entities, json, media, post, single, spread_table, table, turn_id, turn_post

# --- media -----------------------------------------------------------------------


def _order_key():
    return F.col("o_orderkey").cast("string")


def _variant(address, bitrate):
    return F.struct(
        F.lit("video/mp4").alias("content_type"),
        F.concat(F.lit(address), _order_key()).alias("url"),
        bitrate.cast("bigint").alias("bitrate"),
    )


def _video_info(millis):
    return F.struct(
        F.array(F.lit(16), F.lit(9)).alias("aspect_ratio"),
        millis.cast("bigint").alias("duration_millis"),
        F.array(
            _variant("https://v/low/", F.lit(None)),
            _variant("https://v/a/", F.col("o_custkey") % 7),
            _variant("https://v/b/", F.col("o_orderkey") % 7),
        ).alias("variants"),
    )


def _millis():
    return F.col("o_custkey").cast("bigint") * 500



def _order_documents(spark, sf_dir):
    """One post per order with a photo and a video (or animated picture)."""
    orders = spread_table(spark, sf_dir, "orders")
    key = _order_key()
    kind = F.when(F.col("o_orderstatus") == "F", "animated_gif").otherwise("video")
    page = F.when(F.col("o_orderpriority") == "5-LOW", "https://x.com/same").otherwise(
        F.concat(F.lit("https://x.com/v2/"), key)
    )
    items = [
        media(F.concat(F.lit("p"), key), "photo", "https://x.com/p", F.concat(F.lit("https://img/"), key, F.lit(".jpg"))),
        media(F.concat(F.lit("v"), key), kind, "https://x.com/same", "https://img/v.jpg",
              video_info=_video_info(_millis())),
        media(F.concat(F.lit("w"), key), "video", page, "https://img/w.jpg",
              video_info=_video_info(_millis() + 1000)),
    ]
    return single(orders, key, json(post(key, F.col("o_orderpriority"), entities_=entities(media=items))))


_BEST = """CASE WHEN greatest(o_custkey % 7, o_orderkey % 7) = 0 THEN 'https://v/low/'
                WHEN o_custkey % 7 >= o_orderkey % 7 THEN 'https://v/a/' ELSE 'https://v/b/' END || o_orderkey"""


@query(
    "video_durations",
    """SELECT CAST(o_orderkey AS VARCHAR) AS id, 'https://x.com/same' AS video, o_custkey * 0.5::DOUBLE AS seconds
       FROM orders WHERE o_orderstatus <> 'F' AND o_orderpriority <> '5-LOW'
       UNION ALL
       SELECT CAST(o_orderkey AS VARCHAR),
              CASE WHEN o_orderpriority = '5-LOW' THEN 'https://x.com/same' ELSE 'https://x.com/v2/' || o_orderkey END,
              o_custkey * 0.5::DOUBLE + 1 FROM orders""",
)
def video_durations(spark, sf_dir):
    found = posts.extract_posts(_order_documents(spark, sf_dir))
    return found.select("id", F.explode("video_durations").alias("video", "seconds"))


_CANDIDATES = f"""SELECT CAST(o_orderkey AS VARCHAR) AS tweet_id, 'p' || o_orderkey AS media_id,
        'https://img/' || o_orderkey || '.jpg?name=orig' AS media_url, CAST(NULL AS VARCHAR) AS thumbnail_url, 'image' AS media_type,
        CAST(NULL AS BIGINT) AS media_duration FROM orders
    UNION ALL
    SELECT CAST(o_orderkey AS VARCHAR), 'v' || o_orderkey, {_BEST}, 'https://img/v.jpg?name=orig',
        CASE WHEN o_orderstatus = 'F' THEN 'animated_gif' ELSE 'video' END,
        CAST(round_even(o_custkey * 0.5::DOUBLE, 0) AS BIGINT) FROM orders
    UNION ALL
    SELECT CAST(o_orderkey AS VARCHAR), 'w' || o_orderkey, {_BEST}, 'https://img/w.jpg?name=orig', 'video',
        CAST(round_even(o_custkey * 0.5::DOUBLE + 1, 0) AS BIGINT) FROM orders"""

_MEDIA_COLUMNS = ("tweet_id", "media_id", "media_url", "thumbnail_url", "media_type", "media_duration")


@query("media_candidates", _CANDIDATES)
def media_candidates(spark, sf_dir):
    found = posts.extract_posts(_order_documents(spark, sf_dir))
    return media_ops.media_candidates(found, thumbnails=True, video_length_limit=None).select(*_MEDIA_COLUMNS)


@query(
    "video_limit",
    f"""SELECT tweet_id, media_id, media_duration FROM ({_CANDIDATES})
        WHERE media_type <> 'image' AND media_duration <= 30""",
)
def video_limit(spark, sf_dir):
    found = posts.extract_posts(_order_documents(spark, sf_dir))
    return media_ops.media_candidates(found, images=False).select("tweet_id", "media_id", "media_duration")


@query(
    "best_variant",
    f"SELECT CAST(o_orderkey AS VARCHAR) AS id, {_BEST} AS best_url FROM orders",
)
def best_variant(spark, sf_dir):
    variants = _video_info(_millis())["variants"]
    return table(spark, sf_dir, "orders").select(
        _order_key().alias("id"), media_ops.best_variant(variants)["url"].alias("best_url")
    )


@query(
    "attach_media",
    f"""SELECT tweet_id AS conv_id, count(*) AS n_media, CAST(sum(media_duration) AS BIGINT) AS seconds
        FROM ({_CANDIDATES}) GROUP BY tweet_id""",
)
def attach_media(spark, sf_dir):
    found = media_ops.attach_media(posts.extract_posts(_order_documents(spark, sf_dir)))
    seconds = F.aggregate(
        "extracted_media",
        F.lit(0).cast("bigint"),
        lambda acc, m: acc + F.coalesce(m["media_duration"], F.lit(0).cast("bigint")),
    )
    return found.select(
        "conv_id", F.size("extracted_media").cast("bigint").alias("n_media"), seconds.alias("seconds")
    )


@query(
    "media_for_ids",
    f"""SELECT tweet_id AS conv_id, media_id, media_url FROM ({_CANDIDATES})
        WHERE tweet_id IN (SELECT CAST(o_orderkey AS VARCHAR) FROM orders WHERE o_orderpriority = '1-URGENT')""",
)
def media_for_ids(spark, sf_dir):
    wanted = (
        table(spark, sf_dir, "orders")
        .where(F.col("o_orderpriority") == "1-URGENT")
        .select(_order_key().alias("tweet_id"))
    )
    found = media_ops.media_of_listed(_order_documents(spark, sf_dir), wanted)
    return found.select("conv_id", "media_id", "media_url")


_EXT = r"""regexp_extract(regexp_replace(regexp_replace(url, '[?#].*$', ''), '^[a-z]+://[^/]*', ''), '[^/]*$', 0)"""


@query(
    "media_keys",
    f"""SELECT page_id, key, 's3://media/' || key AS location,
              CASE WHEN key LIKE '%.jpg' THEN 'image/jpeg' WHEN key LIKE '%.png' THEN 'image/png'
                   ELSE 'application/octet-stream' END AS content_type
        FROM (SELECT page_id, CAST(page_id AS VARCHAR) || '/m' || page_id
                || CASE WHEN page_id % 3 = 0 THEN '.jpg' WHEN page_id % 3 = 1 THEN '.v1.PNG'
                        WHEN {_EXT} LIKE '%.%' THEN '.' || regexp_extract({_EXT}, '[^.]*$', 0) ELSE '' END AS key_raw,
                replace(key_raw, '.v1.PNG', '.v1') AS key FROM pages)""",
)
def media_keys(spark, sf_dir):
    pages = table(spark, sf_dir, "pages")
    key = F.col("page_id").cast("string")
    # Every third address ends in a picture name before its query, every third id has a dot.
    rows = pages.select(
        "page_id",
        key.alias("tweet_id"),
        F.concat(F.lit("m"), key, F.when(F.col("page_id") % 3 == 1, ".v1").otherwise("")).alias("media_id"),
        F.when(F.col("page_id") % 3 == 0, F.concat(F.lit("https://img.org/a.b/c.jpg?u="), F.col("url")))
        .otherwise(F.col("url"))
        .alias("media_url"),
    )
    return media_ops.media_storage_keys(rows, "media").select("page_id", "key", "location", "content_type")


def _event_manifest(spark, sf_dir):
    key = F.col("event_id").cast("string")
    return table(spark, sf_dir, "events").select(
        F.col("user_id").cast("string").alias("tweet_id"),
        key.alias("media_id"),
        F.concat(F.col("event_type"), F.lit("/"), key).alias("media_url"),
        F.concat(F.lit("k/"), key).alias("key"),
    )


def _event_objects(spark, sf_dir):
    """Objects of the view events; those of small value are empty."""
    return table(spark, sf_dir, "events").where(F.col("event_type") == "view").select(
        F.concat(F.lit("k/"), F.col("event_id").cast("string")).alias("key"),
        F.when(F.col("value") < 20, 0).otherwise(10).cast("bigint").alias("length"),
    )


@query(
    "skip_stored",
    "SELECT CAST(event_id AS VARCHAR) AS media_id FROM events WHERE event_type <> 'view' OR value < 20",
)
def skip_stored(spark, sf_dir):
    objects = _event_objects(spark, sf_dir)
    return media_ops.skip_stored_media(_event_manifest(spark, sf_dir), objects).select("media_id")


def _local_fetch(address: str) -> bytes:
    kind = address.split("/")[0]
    if kind == "error":
        raise OSError("not reachable")
    return b"" if kind == "view" else address.encode()


def _local_sink(key: str, data: bytes) -> str:
    return f"mem://{key}"


@query(
    "fetch_media",
    """SELECT CAST(user_id AS VARCHAR) AS tweet_id, CAST(event_id AS VARCHAR) AS media_id,
              CASE WHEN event_type NOT IN ('error', 'view') THEN 'mem://k/' || event_id END AS location,
              CAST(CASE WHEN event_type IN ('error', 'view') THEN 3 ELSE 1 END AS BIGINT) AS attempts,
              CASE event_type WHEN 'error' THEN 'OSError: not reachable' WHEN 'view' THEN 'OSError: empty payload' END
                AS error FROM events""",
)
def fetch_media(spark, sf_dir):
    fetched = fetch.fetch_media(
        _event_manifest(spark, sf_dir),
        _local_fetch,
        _local_sink,
        max_retries=2,
        retry_delay=0.0,
        partitions=spark.sparkContext.defaultParallelism,
    )
    return fetched.withColumn("attempts", F.col("attempts").cast("bigint"))


@query(
    "fetch_in_parts",
    """SELECT CAST(event_id AS VARCHAR) AS media_id, CASE WHEN event_type NOT IN ('error', 'view') THEN 'k/' || event_id END AS key,
              CASE WHEN event_type NOT IN ('error', 'view') THEN strlen(event_type || '/' || event_id)::BIGINT END AS length
       FROM events""",
)
def fetch_in_parts(spark, sf_dir):
    """Payloads in chunks of three bytes, stored in parts of eight below a shared folder."""
    root = work_dir(spark, "parts")
    manifest = _event_manifest(spark, sf_dir)
    done = written(
        fetch.fetch_media(manifest, _local_chunks, FolderSink(root), max_retries=0, retry_delay=0.0, part_bytes=8,
                          partitions=spark.sparkContext.defaultParallelism), "fetched",
    )
    there = list_objects(spark, root)
    key = F.concat(F.lit("k/"), "media_id")
    found = done.join(there, (key == there["key"]) & F.col("location").isNotNull(), "left")
    return found.select("media_id", "key", "length")


def _local_chunks(address):
    data = _local_fetch(address)
    return (data[i : i + 3] for i in range(0, len(data), 3))


@query(
    "stored_locations",
    """SELECT CAST(user_id AS VARCHAR) AS tweet_id, CAST(event_id // 1000 AS INTEGER) AS list_no,
              string_agg('mem://' || event_id, ',' ORDER BY event_id) AS locations
       FROM events WHERE event_type <> 'error' GROUP BY user_id, event_id // 1000""",
)
def stored_locations(spark, sf_dir):
    ok = F.col("event_type") != "error"
    results = table(spark, sf_dir, "events").select(
        F.col("user_id").cast("string").alias("tweet_id"),
        "event_id",
        F.when(ok, F.concat(F.lit("mem://"), F.col("event_id").cast("string"))).alias("location"),
    )
    return media_ops.stored_locations(results, position="event_id").select(
        "tweet_id", "list_no", F.array_join("locations", ",").alias("locations")
    )


@query(
    "media_stage",
    """SELECT CAST(user_id AS VARCHAR) AS tweet_id, CAST(event_id // 1000 AS INTEGER) AS list_no,
              string_agg(CASE WHEN event_type = 'view' THEN 's3://media/k/' ELSE 'mem://k/' END || event_id, ','
                         ORDER BY event_id) AS locations
       FROM events WHERE event_type <> 'error' AND (event_type <> 'view' OR value >= 20)
       GROUP BY user_id, event_id // 1000""",
)
def media_stage(spark, sf_dir):
    manifest = _event_manifest(spark, sf_dir).withColumns(
        {"media_pos": F.col("media_id").cast("bigint"), "location": F.concat(F.lit("s3://media/"), F.col("key"))}
    )
    done = run_media(
        spark,
        manifest,
        _event_objects(spark, sf_dir),
        _local_fetch,
        _local_sink,
        work_dir(spark, "media"),
        run_id="1",
        max_retries=1,
        retry_delay=0.0,
        partitions=spark.sparkContext.defaultParallelism,
    )
    return done.locations.withColumn("locations", F.array_join("locations", ","))


# --- sinks -----------------------------------------------------------------------


def _halves(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice", "o_orderstatus", "o_orderpriority")
    target = orders.where(F.col("o_orderstatus").isin("F", "O")).drop("o_orderstatus")
    doubled = F.when(F.col("o_orderpriority") == "5-LOW", F.col("o_totalprice")).otherwise(
        F.col("o_totalprice") * 2
    )
    updates = (
        orders.where(F.col("o_orderstatus").isin("O", "P"))
        .withColumn("o_totalprice", doubled)
        .drop("o_orderstatus")
    )
    return target, updates


@query(
    "upsert_docs",
    """SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' OR o_orderpriority = '5-LOW' THEN o_totalprice
                               ELSE o_totalprice * 2 END AS o_totalprice, o_orderpriority FROM orders""",
)
def upsert_docs(spark, sf_dir):
    target, updates = _halves(spark, sf_dir)
    first = updates.withColumns({"o_totalprice": F.lit(-1.0), "seq": F.lit(1)})
    return tables.upsert_documents(
        target, first.unionByName(updates.withColumn("seq", F.lit(2))), "o_orderkey", order="seq"
    )


@query(
    "upsert_raw",
    """SELECT o_orderkey,
              CASE WHEN o_orderstatus = 'P' THEN NULL ELSE o_orderpriority END AS kept,
              CASE WHEN o_orderstatus = 'F' THEN 'old' ELSE 'new' END AS shared,
              CASE WHEN o_orderstatus = 'F' THEN NULL ELSE o_orderstatus END AS added FROM orders""",
)
def upsert_raw(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    old = F.to_json(F.struct(F.col("o_orderpriority").alias("kept"), F.lit("old").alias("shared")))
    # Two updates per order: the second one only repeats the shared field.
    first = F.to_json(F.struct(F.col("o_orderstatus").alias("added"), F.lit("mid").alias("shared")))
    second = F.to_json(F.struct(F.lit("new").alias("shared")))
    target = orders.where(F.col("o_orderstatus") != "P").select(
        "o_orderkey", tables.parse_document(old).alias("doc")
    )
    changed = orders.where(F.col("o_orderstatus") != "F")
    updates = changed.select("o_orderkey", F.lit(1).alias("seq"), tables.parse_document(first).alias("doc")).unionByName(
        changed.select("o_orderkey", F.lit(2).alias("seq"), tables.parse_document(second).alias("doc"))
    )
    merged = tables.upsert_raw(target, updates, "o_orderkey", order="seq")
    field = lambda name: F.try_variant_get(F.col("doc")[name], "$", "string").alias(name)
    return merged.select("o_orderkey", field("kept"), field("shared"), field("added"))


@query(
    "upsert_actions",
    """SELECT count(*) FILTER (o_orderstatus = 'P') AS inserted,
              count(*) FILTER (o_orderstatus = 'O' AND o_orderpriority <> '5-LOW') AS updated,
              count(*) FILTER (o_orderstatus = 'O' AND o_orderpriority = '5-LOW') AS unchanged FROM orders""",
)
def upsert_actions(spark, sf_dir):
    return tables.upsert_action_counts(*_halves(spark, sf_dir), "o_orderkey")


@query(
    "ledger_append",
    """SELECT DISTINCT CAST(o_custkey AS VARCHAR) AS tweet_id, TIMESTAMP '2024-01-01 00:00:00' AS created_at
       FROM orders WHERE o_orderstatus <> 'F'
         AND o_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')""",
)
def ledger_append(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select(
        F.col("o_custkey").cast("string").alias("tweet_id"), "o_orderstatus"
    )
    ledger = orders.where(F.col("o_orderstatus") == "F").select("tweet_id").distinct()
    fresh = orders.where(F.col("o_orderstatus") != "F")
    rows = tables.new_ledger_rows(ledger, fresh, datetime(2024, 1, 1))
    return rows.withColumn("created_at", F.col("created_at").cast("timestamp_ntz"))


# --- attempts ----------------------------------------------------------------------


def _attempts(spark, sf_dir):
    return table(spark, sf_dir, "events").select(
        F.col("user_id").cast("string").alias("source"),
        F.col("event_id").alias("seq"),
        F.col("event_id").cast("string").alias("tweet_id"),
        (F.col("event_type") != "error").alias("ok"),
    )


@query(
    "batch_summary",
    """SELECT count(*) FILTER (event_type <> 'error') AS processed,
              count(*) FILTER (event_type = 'error') AS failed FROM events""",
)
def batch_summary(spark, sf_dir):
    return attempts.batch_summary(_attempts(spark, sf_dir))


@query("failed_ids", "SELECT CAST(event_id AS VARCHAR) AS tweet_id FROM events WHERE event_type = 'error'")
def failed_ids(spark, sf_dir):
    return attempts.failed_ids(_attempts(spark, sf_dir))


_STREAKS = """SELECT source, seq FROM (
     SELECT source, seq, ok, row_number() OVER (PARTITION BY source, island, ok ORDER BY seq) AS run FROM (
       SELECT CAST(user_id AS VARCHAR) AS source, event_id AS seq, event_type <> 'error' AS ok,
              sum(CASE WHEN event_type <> 'error' THEN 1 ELSE 0 END)
                OVER (PARTITION BY user_id ORDER BY event_id) AS island FROM events))
   WHERE NOT ok AND run = 2"""


@query("failure_streaks", _STREAKS)
def failure_streaks(spark, sf_dir):
    # Short stretches, so that runs do cross from one stretch into the next.
    found = attempts.failure_streaks(
        _attempts(spark, sf_dir), n=2, stretch=F.expr("seq div 500")
    )
    return found.select("source", "seq")


@query("failure_stops_live", _STREAKS)
def failure_stops_live(spark, sf_dir):
    """The same from a stream of attempts in three micro-batches."""
    state = work_dir(spark, "stops")
    rows = _attempts(spark, sf_dir).withColumn("third", F.ntile(3).over(Window.partitionBy("source").orderBy("seq")))
    for third in (1, 2, 3):
        rows.where(F.col("third") == third).drop("third").write.mode("append").json(f"{state}/incoming")
        arriving = spark.readStream.schema(rows.drop("third").schema).json(f"{state}/incoming")
        breaker.watch_failures(arriving, state, f"{state}/checkpoint", n=2, stretch="seq div 500").awaitTermination()
    return breaker.stops(spark, state).select("source", "seq")


# --- browser bookmarks ----------------------------------------------------------------


def _bookmark_files(spark, sf_dir):
    """A bookmark file per nation and block of 100 customers: bar > region > nation > customers."""
    customer = table(spark, sf_dir, "customer")
    nation = table(spark, sf_dir, "nation")
    region = table(spark, sf_dir, "region")
    named = (
        customer.join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
        .join(region, F.col("n_regionkey") == F.col("r_regionkey"))
    )
    leaf = F.struct(
        "c_custkey",
        F.lit("url").alias("type"),
        F.col("c_name").alias("name"),
        F.concat(F.lit("https://c/"), F.col("c_custkey").cast("string")).alias("url"),
        (F.lit(13350000000000000) + F.col("c_custkey") * 86_400_000_000).cast("string").alias("date_added"),
    )
    folder = lambda name, children: F.struct(
        F.lit("folder").alias("type"), name.alias("name"), children.alias("children")
    )
    leaves = F.array_sort(F.collect_list(leaf))
    top = F.struct(F.lit("url").alias("type"), F.lit("Home").alias("name"), F.lit("https://home").alias("url"),
                   F.lit("13350000000000000").alias("date_added"))
    tree = F.struct(
        F.struct(
            folder(
                F.lit("Bookmarks bar"),
                F.array(folder(F.col("r_name"), F.array(folder(F.col("n_name"), leaves)))),
            ).alias("bookmark_bar"),
            top.alias("other"),
        ).alias("roots")
    )
    whole = named.groupBy("r_name", "n_name", F.expr("c_custkey div 100").alias("block")).agg(
        F.to_json(tree).alias("raw")
    ).select(
        F.concat_ws("/", "n_name", F.lpad(F.col("block").cast("string"), 12, "0")).alias("file"), "raw"
    )
    # One more file per nation whose folder has a bookmark but no name.
    nameless = F.lit('{"roots":{"bar":{"type":"folder","children":[{"type":"url","name":"n","url":"u","date_added":"1"}]}}}')
    return whole.unionByName(nation.select(F.concat("n_name", F.lit("/nameless")).alias("file"), nameless.alias("raw")))


_TREE = """SELECT n_name || '/' || lpad(CAST(c_custkey // 100 AS VARCHAR), 12, '0') AS file, c_custkey,
                  c_name AS name, 'https://c/' || c_custkey AS url, n_name AS folder,
                  CAST(DATE '2024-01-17' + CAST(c_custkey AS INTEGER) AS VARCHAR) AS date_added,
                  'Bookmarks bar/' || r_name || '/' || n_name AS folder_path
           FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
           UNION ALL
           SELECT DISTINCT n_name || '/' || lpad(CAST(c_custkey // 100 AS VARCHAR), 12, '0'),
                  CAST(9223372036854775807 AS BIGINT), 'Home', 'https://home', 'other', '2024-01-17', ''
           FROM customer JOIN nation ON c_nationkey = n_nationkey"""


@query("bookmark_tree", f"SELECT name, url, folder, date_added, folder_path FROM ({_TREE})")
def bookmark_trees(spark, sf_dir):
    found, _ = bookmark_tree.flatten_bookmark_tree(_bookmark_files(spark, sf_dir))
    return found.select(
        "name",
        "url",
        "folder",
        F.col("date_added").cast("string").alias("date_added"),
        F.array_join("folder_path", "/").alias("folder_path"),
    )


@query("broken_trees", "SELECT n_name || '/nameless' AS file, 'flatten' AS stage FROM nation")
def broken_trees(spark, sf_dir):
    _, failed = bookmark_tree.flatten_bookmark_tree(_bookmark_files(spark, sf_dir))
    return failed.select("file", "stage")


@query("preview", f"SELECT name, url FROM ({_TREE}) ORDER BY file, c_custkey LIMIT 10")
def preview(spark, sf_dir):
    found, _ = bookmark_tree.flatten_bookmark_tree(_bookmark_files(spark, sf_dir))
    return bookmark_tree.preview(found).select("name", "url")


# --- whole jobs ------------------------------------------------------------------------

_CONVERSATIONS = """SELECT CAST(conv_id AS VARCHAR) AS conv_id, max(CASE WHEN turn = 0 THEN text END) AS main_text,
                           count(*) - 1 AS n_replies FROM conversations GROUP BY conv_id"""


def _shown(documents):
    """Main text and reply count over all parts of each extracted conversation."""
    return documents.groupBy("conv_id").agg(
        F.max("main_tweet.text").alias("main_text"), F.sum(F.size("replies")).cast("bigint").alias("n_replies")
    )


@query("ingest", _CONVERSATIONS)
def ingest_job(spark, sf_dir):
    state = work_dir(spark, "ingest")
    captures = capture_rows(spark, sf_dir)
    pages = _saved_pages(spark, sf_dir, F.lit(True))
    ingest.run_ingest(spark, pages, captures, state, run_id="1")
    # The second run finds every id in the ledger and adds nothing.
    ingest.run_ingest(spark, pages, captures, state, run_id="2")
    return _shown(ingest.latest_documents(spark, state))


@query("ingest_stream", _CONVERSATIONS)
def ingest_stream_job(spark, sf_dir):
    state = work_dir(spark, "stream")
    capture_rows(spark, sf_dir).write.json(f"{state}/incoming")
    arriving = capture_stream(spark, f"{state}/incoming")
    ingest_stream(arriving, f"{state}/state", f"{state}/checkpoint").awaitTermination()
    return _shown(ingest.latest_documents(spark, f"{state}/state"))


def _saved_pages(spark, sf_dir, where):
    """A page for each saved conversation."""
    saved = table(spark, sf_dir, "conversations").where("turn = 0").where(where)
    page = F.concat(
        F.lit('{"data":{"bookmark_timeline_v2":{"timeline":{"instructions":[{"entries":[{"entryId":"tweet-'),
        F.col("conv_id").cast("string"),
        F.lit('"}]}]}}}}'),
    )
    return saved.select(page.alias("raw"))


def _late_streams(spark, sf_dir, name, pages=None):
    """Two streams into one state; the second one brings what the first one's conversations lack."""
    state = work_dir(spark, name)
    arrived = capture_rows(spark, sf_dir)
    for stream, rows in (("a", arrived.where("capture_no = 0")), ("b", arrived.where("capture_no > 0"))):
        rows.write.json(f"{state}/incoming-{stream}")
        arriving = capture_stream(spark, f"{state}/incoming-{stream}")
        ingest_stream(arriving, f"{state}/state", f"{state}/checkpoint-{stream}", name=stream, pages=pages).awaitTermination()
    late = ingest.late_captures(spark, f"{state}/state").groupBy("conv_id").agg(F.count("*").alias("n_late"))
    shown = _shown(ingest.latest_documents(spark, f"{state}/state"))
    return shown.join(late, "conv_id", "full").withColumn("n_late", F.coalesce("n_late", F.lit(0).cast("bigint")))


@query("ingest_late", f"SELECT *, 0::BIGINT AS n_late FROM ({_CONVERSATIONS})")
def ingest_late(spark, sf_dir):
    return _late_streams(spark, sf_dir, "late")


@query(
    "ingest_late_pages",
    f"""SELECT conv_id, CASE WHEN s THEN main_text END AS main_text, CASE WHEN s THEN n_replies END AS n_replies,
               CASE WHEN s THEN 0 ELSE n_replies // 3 + 1 END AS n_late
        FROM (SELECT *, conv_id::BIGINT % 3 > 0 AS s FROM ({_CONVERSATIONS}))""",
)
def ingest_late_pages(spark, sf_dir):
    """Two thirds of the conversations are saved; the captures of the others are kept as they are."""
    return _late_streams(spark, sf_dir, "late_pages", _saved_pages(spark, sf_dir, "conv_id % 3 > 0"))


@query(
    "ingest_recaptured",
    """SELECT CAST(conv_id AS VARCHAR) AS conv_id, count(*)::BIGINT AS n_posts,
              string_agg(CASE WHEN turn < 3 AND conv_id % 2 = 0 THEN 'again ' ELSE '' END || text, '|' ORDER BY turn) AS texts
       FROM conversations GROUP BY conv_id""",
)
def ingest_recaptured(spark, sf_dir):
    """Of every second conversation the first capture comes again, with other texts, after a compaction."""
    state = work_dir(spark, "recaptured")
    ingest.run_ingest(spark, None, capture_rows(spark, sf_dir), state, run_id="1")
    ingest.compact_state(spark, state)
    changed = turn_post(F.concat(F.lit("again "), F.col("text")))
    again = capture_rows(spark, sf_dir, json(changed)).where("capture_no = 0 AND conv_id % 2 = 0")
    ingest.run_ingest(spark, None, again, state, run_id="2")
    found = ingest.latest_documents(spark, state)
    texts = F.array_join(F.concat(F.array("main_tweet.text"), F.transform("replies", lambda r: r["text"])), "|")
    return found.select("conv_id", (F.size("replies") + 1).cast("bigint").alias("n_posts"), texts.alias("texts"))


@query(
    "ingest_parts",
    """SELECT CAST(conv_id AS VARCHAR) AS conv_id, max(CASE WHEN turn = 0 THEN text END) AS main_text,
              count(*) - 1 AS n_replies, CASE WHEN conv_id % 2 = 0 THEN count(DISTINCT turn * 40 // 64) ELSE 1 END AS n_parts
       FROM conversations GROUP BY conv_id""",
)
def ingest_parts(spark, sf_dir):
    """Captures of every second conversation are numbered so far apart that it is cut into parts."""
    state = work_dir(spark, "parts")
    single_turns = capture_rows(spark, sf_dir, per_capture=1)
    number = F.when(F.col("conv_id") % 2 == 0, F.col("capture_no") * 40).otherwise(F.col("capture_no"))
    ingest.run_ingest(spark, None, single_turns.withColumn("capture_no", number), state, run_id="1")
    found = ingest.latest_documents(spark, state)
    return found.groupBy("conv_id").agg(
        F.max("main_tweet.text").alias("main_text"), F.sum(F.size("replies")).cast("bigint").alias("n_replies"), F.count("*").alias("n_parts")
    )


@query(
    "ingest_raw",
    """SELECT CAST(conv_id AS VARCHAR) AS conv_id, count(*)::BIGINT AS n_entries, CASE WHEN conv_id % 2 = 0 THEN 'b' ELSE 'a' END AS note,
              CASE WHEN conv_id % 2 = 0 THEN NULL ELSE conv_id END AS seen FROM conversations GROUP BY conv_id""",
)
def ingest_raw(spark, sf_dir):
    """Raw documents after two runs of ingest and two of another source, merged by field."""
    state = work_dir(spark, "raw")
    arrived = capture_rows(spark, sf_dir)
    ingest.run_ingest(spark, None, arrived.where("capture_no = 0"), state, run_id="1")
    ids = table(spark, sf_dir, "conversations").select("conv_id").distinct()
    key = (F.col("conv_id").cast("string").alias("conv_id"), F.lit(0).alias("part"))
    keys = ("conv_id", "part")
    note = ids.select(*key, F.to_json(F.struct(F.lit("a").alias("note"), F.when(F.col("conv_id") % 2 > 0, F.col("conv_id")).alias("seen"))).alias("raw"))
    raw.append_documents(spark, state, note, "2", keys)
    ingest.run_ingest(spark, None, arrived.where("capture_no > 0"), state, run_id="3")
    raw.append_documents(spark, state, ids.where("conv_id % 2 = 0").select(*key, F.lit('{"note":"b"}').alias("raw")), "4", keys)
    merged = raw.current_documents(spark, state, keys)
    parsed = F.from_json("raw", f"struct<`{ROOT_KEY}`:struct<instructions:array<struct<entries:array<string>>>>,note:string,seen:bigint>")
    shown = merged.select("conv_id", parsed.alias("d"))
    entries = F.col("d")[ROOT_KEY]["instructions"][0]["entries"]
    return shown.select("conv_id", F.size(entries).cast("bigint").alias("n_entries"), "d.note", "d.seen")


@query(
    "raw_runs",
    """SELECT o_orderkey, o_orderpriority AS kept, CASE WHEN o_orderstatus = 'F' THEN 'one' WHEN o_orderstatus = 'P' THEN 'three' ELSE 'two' END AS shared,
              CASE WHEN o_orderstatus <> 'F' THEN o_orderstatus END AS added FROM orders""",
)
def raw_runs(spark, sf_dir):
    """Three runs of raw documents, compacted after the second one."""
    state = work_dir(spark, "raw_runs")
    orders = table(spark, sf_dir, "orders")

    def add(run, rows, **fields):
        text = F.to_json(F.struct(*[c.alias(name) for name, c in fields.items()]))
        raw.append_documents(spark, state, rows.select("o_orderkey", text.alias("raw")), run, ("o_orderkey",))

    add("1", orders, kept=F.col("o_orderpriority"), shared=F.lit("one"))
    add("2", orders.where("o_orderstatus <> 'F'"), shared=F.lit("two"), added=F.col("o_orderstatus"))
    raw.compact_documents(spark, state, ("o_orderkey",))
    add("3", orders.where("o_orderstatus = 'P'"), shared=F.lit("three"))
    merged = raw.current_documents(spark, state, ("o_orderkey",))
    return merged.select("o_orderkey", F.from_json("raw", "struct<kept:string,shared:string,added:string>").alias("d")).select("o_orderkey", "d.*")


@query("batch_rerun", "SELECT conv_id || '_' || turn AS conv_id, text AS main_text FROM conversations")
def batch_rerun(spark, sf_dir):
    output = work_dir(spark, "rerun")
    docs = single(spread_table(spark, sf_dir, "conversations"), turn_id(), json(turn_post()))
    for _ in range(2):
        batch.extract_batch(spark, docs, output, "1")
    on_disk = spark.read.schema("conv_id string, main_tweet struct<text: string>").json(f"{output}/documents")
    return on_disk.select("conv_id", F.col("main_tweet.text").alias("main_text"))


@query("batch_extract", _CANDIDATES.replace("'https://img/v.jpg?name=orig'", "CAST(NULL AS VARCHAR)").replace("'https://img/w.jpg?name=orig'", "CAST(NULL AS VARCHAR)"))
def batch_extract(spark, sf_dir):
    output = work_dir(spark, "batch")
    done = batch.extract_batch(spark, _order_documents(spark, sf_dir), output, "1", compression="gzip")
    return media_ops.explode_media(done.documents).select(*_MEDIA_COLUMNS)


@query(
    "workflow",
    """SELECT o_orderkey::VARCHAR AS tweet_id, 0::INTEGER AS list_no,
              string_agg(CASE WHEN m = 'p' AND o_custkey % 2 = 0 THEN 's3://media/' ELSE 'mem://' END || o_orderkey || '/' || m || o_orderkey
                         || CASE WHEN m = 'p' THEN '.jpg' ELSE '' END, ',' ORDER BY m) AS locations
       FROM orders, unnest(['p', 'v', 'w']) AS x(m) GROUP BY o_orderkey""",
)
def workflow_job(spark, sf_dir):
    """Captures to stored media in one call; every second photo is there already."""
    state = work_dir(spark, "workflow")
    raw_ = _order_documents(spark, sf_dir)
    captures = raw_.select("conv_id", F.lit(0).alias("capture_no"), F.concat(F.lit('{"data":'), "raw", F.lit("}")).alias("raw"))
    key = _order_key()
    objects = table(spark, sf_dir, "orders").where("o_custkey % 2 = 0").select(
        F.concat(key, F.lit("/p"), key, F.lit(".jpg")).alias("key"), F.lit(7).cast("bigint").alias("length")
    )
    done = run_workflow(
        spark, None, captures, state, _fetch_name, _mem_sink, run_id="1", objects=objects,
        media_options={"retry_delay": 0.0, "partitions": spark.sparkContext.defaultParallelism},
    )
    return done.media.locations.withColumn("locations", F.array_join("locations", ","))


def _fetch_name(address):
    return address.encode()


def _mem_sink(key, data):
    return f"mem://{key}"
