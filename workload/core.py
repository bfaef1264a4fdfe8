"""Queries over ids, the ledger, posts and conversations."""

from __future__ import annotations

from pyspark.sql import functions as F

from marklake.functions.scalars import bookmark_label, status_url, webkit_date, whole_seconds
from marklake.functions.text import REMOVE, REPLACE, strip, trim_trailing_urls
from marklake.operators import captures, conversations, ids, posts, transcript, validate
from workload.registry import query, written
from workload.shapes import (
    CURSOR_ITEM,
    document,
    entities,
    entry,
    item,
    join_entries,
    json,
    mention,
    module_entry,
    obj,
    post,
    single,
    spread_table,
    table,
    thread,
    turn_id,
    turn_post,
    url,
)

# --- ids and ledger ------------------------------------------------------------


def _pages(spark, sf_dir, entry_id):
    """One export page per user and block of 100 events."""
    events = table(spark, sf_dir, "events")
    entries = F.array_sort(F.collect_list(F.struct("event_id", entry_id.alias("entryId"))))
    listed = F.transform(entries, lambda e: F.struct(e["entryId"].alias("entryId")))
    page = obj(data={"bookmark_timeline_v2": {"timeline": {"instructions": [{"entries": listed}]}}})
    block = F.expr("event_id div 100").alias("page_no")
    return events.groupBy("user_id", block).agg(json(page).alias("raw"))


def _entry_id():
    kind = F.when(F.col("event_type") == "error", "cursor-bottom-").otherwise("tweet-")
    return F.concat(kind, F.col("event_id").cast("string"))


@query(
    "saved_ids",
    "SELECT user_id, CAST(event_id AS VARCHAR) AS tweet_id FROM events WHERE event_type <> 'error'",
)
def saved_ids(spark, sf_dir):
    return ids.extract_saved_ids(_pages(spark, sf_dir, _entry_id())).select("user_id", "tweet_id")


@query(
    "saved_ids_broken",
    """SELECT user_id, CAST(event_id AS VARCHAR) AS tweet_id
       FROM (SELECT *, min(CASE WHEN event_type = 'purchase' THEN event_id END)
                         OVER (PARTITION BY user_id, event_id // 100) AS cut FROM events)
       WHERE event_type NOT IN ('error', 'purchase') AND (cut IS NULL OR event_id < cut)""",
)
def saved_ids_broken(spark, sf_dir):
    broken = F.when(F.col("event_type") != "purchase", _entry_id())
    return ids.extract_saved_ids(_pages(spark, sf_dir, broken)).select("user_id", "tweet_id")


def _ids_and_ledger(spark, sf_dir):
    listed = table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("tweet_id"))
    done = (
        table(spark, sf_dir, "orders")
        .where(F.col("o_orderpriority") == "1-URGENT")
        .select(F.col("o_custkey").cast("string").alias("tweet_id"))
        .distinct()
    )
    return listed.unionByName(listed), done


_DONE = "SELECT DISTINCT CAST(o_custkey AS VARCHAR) AS tweet_id FROM orders WHERE o_orderpriority = '1-URGENT'"
_LISTED = "SELECT CAST(c_custkey AS VARCHAR) AS tweet_id FROM customer"


@query("pending", f"{_LISTED} EXCEPT {_DONE}")
def pending(spark, sf_dir):
    return ids.find_pending(*_ids_and_ledger(spark, sf_dir))


@query(
    "pending_stats",
    f"""SELECT (SELECT count(*) FROM ({_LISTED})) AS total_tweets,
               (SELECT count(*) FROM ({_DONE})) AS processed_tweets,
               (SELECT count(*) FROM ({_LISTED} EXCEPT {_DONE})) AS pending_tweets""",
)
def pending_stats(spark, sf_dir):
    return ids.pending_stats(*_ids_and_ledger(spark, sf_dir))


@query("ledger_count", f"SELECT count(*) AS n FROM ({_DONE})")
def ledger_count(spark, sf_dir):
    return ids.ledger_count(_ids_and_ledger(spark, sf_dir)[1])


@query("ordered_ids", f"{_LISTED} ORDER BY 1")
def ordered_ids(spark, sf_dir):
    return ids.ordered_ids(_ids_and_ledger(spark, sf_dir)[0])


@query(
    "skip_processed",
    """SELECT CAST(o_orderkey AS VARCHAR) AS conv_id FROM orders
       WHERE o_orderstatus <> 'F' OR o_orderpriority = '5-LOW'""",
)
def skip_processed(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    key = F.col("o_orderkey").cast("string").alias("conv_id")
    text = F.to_json(F.struct("o_orderkey", "o_totalprice"))
    cut_short = F.when(F.col("o_orderpriority") == "5-LOW", F.substring(text, F.lit(1), F.length(text) - 1))
    outputs = orders.where(F.col("o_orderstatus") == "F").select(
        key, F.coalesce(cut_short, text).alias("value")
    )
    return ids.skip_processed(orders.select(key), outputs)


# --- conversations --------------------------------------------------------------


def _thread(spark, sf_dir, result_json=None, extra=False):
    result_json = json(turn_post()) if result_json is None else result_json
    return thread(table(spark, sf_dir, "conversations"), result_json, extra)


def main_and_replies(extracted):
    """Main text and number of replies of each conversation, over all its posts."""
    is_main = F.col("role") == "main"
    return extracted.groupBy("conv_id").agg(
        F.max_by("text", F.when(is_main, F.struct("part", "pos"))).alias("main_text"),
        F.count_if(~is_main).alias("n_replies"),
    )


@query(
    "conversation_main",
    """SELECT CAST(conv_id AS VARCHAR) AS conv_id, max(CASE WHEN turn = 0 THEN text END) AS main_text,
              count(*) - 1 AS n_replies FROM conversations GROUP BY conv_id""",
)
def conversation_main(spark, sf_dir):
    return main_and_replies(posts.extract_posts(_thread(spark, sf_dir)))


@query(
    "posts_flat",
    """SELECT CAST(conv_id AS VARCHAR) AS conv_id, CASE WHEN turn = 0 THEN 'main' ELSE 'reply' END AS role,
              conv_id || '_' || turn AS id, text, role AS username FROM conversations""",
)
def posts_flat(spark, sf_dir):
    return posts.extract_posts(_thread(spark, sf_dir, extra=True)).select(
        "conv_id", "role", "id", "text", "username"
    )


@query(
    "entries",
    """SELECT CAST(conv_id AS VARCHAR) AS conv_id, CAST(turn // 64 AS INTEGER) AS part,
              CAST(1 AS INTEGER) AS instr_pos, CAST(3 * (turn % 64) AS INTEGER) AS entry_pos,
              CASE WHEN turn = 0 THEN 'main' ELSE 'reply' END AS role, 'post' AS status FROM conversations""",
)
def entries(spark, sf_dir):
    return posts.explode_entries(_thread(spark, sf_dir, extra=True)).select(
        "conv_id", "part", "instr_pos", "entry_pos", "role", "status"
    )


@query(
    "two_mains",
    """SELECT CAST(conv_id AS VARCHAR) AS conv_id, CAST(turn // 64 AS INTEGER) AS part, CAST(0 AS INTEGER) AS doc_no,
              CASE WHEN max(turn) = max(max(turn)) OVER (PARTITION BY conv_id) THEN max_by(text, turn) END AS main_text,
              count(*) FILTER (turn % 2 = 1) AS n_replies
       FROM conversations GROUP BY conv_id, turn // 64""",
)
def two_mains(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations")
    body = item(json(turn_post()))
    every = F.concat_ws(
        ",",
        F.when(F.col("turn") % 2 == 1, module_entry(F.concat(F.lit("conversationthread-"), turn_id()), body)),
        entry(F.concat(F.lit("tweet-"), turn_id()), body),
    )
    found = posts.extract_posts(join_entries(rows, "conv_id", "turn", every))
    documents, _ = conversations.assemble_conversations(written(found, "posts"))
    return documents.select(
        "conv_id",
        "part",
        "doc_no",
        F.col("main_tweet.text").alias("main_text"),
        F.size("replies").cast("bigint").alias("n_replies"),
    )


@query(
    "conversation_documents",
    """SELECT CAST(conv_id AS VARCHAR) AS conv_id, CAST(turn // 64 AS INTEGER) AS part,
              max(CASE WHEN turn = 0 THEN text END) AS main_text,
              string_agg(CASE WHEN turn > 0 THEN text END, '|' ORDER BY turn) AS reply_texts
       FROM conversations GROUP BY conv_id, turn // 64""",
)
def conversation_documents(spark, sf_dir):
    built = conversations.extract_conversations(_thread(spark, sf_dir))
    texts = F.array_join(F.transform("replies", lambda r: r["text"]), "|")
    return built.select(
        "conv_id", "part", F.col("main_tweet.text").alias("main_text"), F.when(texts != "", texts).alias("reply_texts")
    )


@query(
    "assembled_documents",
    """SELECT CAST(conv_id AS VARCHAR) AS conv_id, CAST(turn // 64 AS INTEGER) AS part, CAST(0 AS INTEGER) AS doc_no,
              max(CASE WHEN turn = 0 THEN text END) AS main_text,
              string_agg(CASE WHEN turn > 0 THEN text END, '|' ORDER BY turn) AS reply_texts
       FROM conversations GROUP BY conv_id, turn // 64""",
)
def assembled_documents(spark, sf_dir):
    found = posts.extract_posts(_thread(spark, sf_dir))
    documents, _ = conversations.assemble_conversations(written(found, "posts"))
    texts = F.array_join(F.transform("replies", lambda r: r["text"]), "|")
    return documents.select(
        "conv_id", "part", "doc_no", F.col("main_tweet.text").alias("main_text"), F.when(texts != "", texts).alias("reply_texts")
    )


@query(
    "post_variants",
    """SELECT CAST(conv_id AS VARCHAR) AS conv_id, turn AS pos,
              CASE turn % 5 WHEN 2 THEN '[Tweet unavailable]' WHEN 3 THEN '[No tweet text available]'
                            WHEN 4 THEN '[Unknown tweet format]' ELSE text END AS text,
              CASE WHEN turn % 5 < 2 THEN conv_id || '_' || turn ELSE '' END AS id
       FROM conversations""",
)
def post_variants(spark, sf_dir):
    plain = json(turn_post())
    wrapped = F.concat(
        F.lit('{"__typename":"TweetWithVisibilityResults","tweet":'), json(turn_post(typename=None)), F.lit("}")
    )
    kind = F.col("turn") % 5
    result = (
        F.when(kind == 0, plain)
        .when(kind == 1, wrapped)
        .when(kind == 2, F.lit('{"__typename":"TweetTombstone","tombstone":{}}'))
        .when(kind == 4, F.lit('{"__typename":"UserUnavailable"}'))
    )
    extracted = posts.extract_posts(_thread(spark, sf_dir, result))
    return extracted.select(
        "conv_id", (F.col("part") * 64 + F.col("pos")).cast("bigint").alias("pos"), "text", "id"
    )


# --- text -----------------------------------------------------------------------

_HALF = "CAST(length(text) // 2 AS BIGINT)"
_LINK, _LONG = "https://t.co/abc", "https://example.org/long/"


@query(
    "url_expansion",
    f"""SELECT conv_id || '_' || turn AS id,
               substring(text, 1, {_HALF}) || '{_LONG}' || turn || substring(text, {_HALF} + 1) || ' {_LONG}end' AS text
        FROM conversations""",
)
def url_expansion(spark, sf_dir):
    half = F.expr("cast(length(text) div 2 as int)")
    text = F.concat(
        F.expr("left(text, length(text) div 2)"),
        F.lit(_LINK),
        F.expr("substring(text, cast(length(text) div 2 as int) + 1)"),
        F.lit(f" {_LINK}"),
    )
    links = [
        url(_LINK, F.concat(F.lit(_LONG), F.col("turn").cast("string")), half, half + len(_LINK)),
        url(
            _LINK,
            F.lit(f"{_LONG}end"),
            F.length("text") + len(_LINK) + 1,
            F.length("text") + 2 * len(_LINK) + 1,
        ),
    ]
    rows = spread_table(spark, sf_dir, "conversations")
    result = json(turn_post(text, entities_=entities(urls=links)))
    return posts.extract_posts(single(rows, turn_id(), result)).select("id", "text")


def _media_text(mode):
    def run(spark, sf_dir):
        from workload.shapes import media

        start = F.length("text") + 1
        photo = media("m", "photo", "https://x.com/p/1", "https://img/1.jpg", start, start + len(_LINK))
        text = F.concat("text", F.lit(f" {_LINK}"))
        result = json(turn_post(text, entities_=entities(media=[photo])))
        docs = single(spread_table(spark, sf_dir, "conversations"), turn_id(), result)
        return posts.extract_posts(docs, mode).select("id", "text")

    return run


for _mode, _tail in (("keep", _LINK), (REPLACE, "https://x.com/p/1"), (REMOVE, "")):
    query(
        f"media_text_{_mode}",
        f"SELECT conv_id || '_' || turn AS id, text || ' {_tail}' AS text FROM conversations",
    )(_media_text(_mode))


@query(
    "text_functions",
    """SELECT conv_id || '_' || turn AS id, text AS stripped, text AS trimmed,
              'https://x.com/i/status/' || turn AS status FROM conversations""",
)
def text_functions(spark, sf_dir):
    pad = F.lit("\t\n   　\x1c")
    padded = F.concat(pad, F.col("text"), pad)
    links = F.array(F.struct(F.lit("https://t.co/b").alias("url")), F.struct(F.lit("https://t.co/a").alias("url")))
    tailed = F.concat("text", F.lit(" https://t.co/a "), F.lit("https://t.co/b"))
    return table(spark, sf_dir, "conversations").select(
        turn_id().alias("id"),
        strip(padded).alias("stripped"),
        trim_trailing_urls(tailed, links).alias("trimmed"),
        status_url(F.col("turn").cast("string")).alias("status"),
    )


@query(
    "scalar_functions",
    """SELECT event_id,
              CAST(DATE '1601-01-01' + CAST(event_id AS INTEGER) AS VARCHAR) AS webkit_day,
              CAST(round_even(value, 0) AS BIGINT) AS seconds,
              event_type || ' (u' || user_id || ') added on '
                || CAST(DATE '1601-01-01' + CAST(event_id AS INTEGER) AS VARCHAR) AS label
       FROM events""",
)
def scalar_functions(spark, sf_dir):
    # A few microseconds before the next midnight, where rounding would show.
    micros = (F.col("event_id") * 86_400_000_000 + 86_399_999_999).cast("string")
    day = webkit_date(micros)
    return table(spark, sf_dir, "events").select(
        "event_id",
        day.cast("string").alias("webkit_day"),
        whole_seconds(F.round(F.col("value") * 1000).cast("bigint")).alias("seconds"),
        bookmark_label(F.col("event_type"), F.concat(F.lit("u"), F.col("user_id").cast("string")), day).alias(
            "label"
        ),
    )


@query(
    "created_ts",
    "SELECT CAST(event_id AS VARCHAR) AS id, date_trunc('second', ts) AS created_ts FROM events",
)
def created_ts(spark, sf_dir):
    events = spread_table(spark, sf_dir, "events")
    stamp = F.concat(
        F.date_format(F.col("ts").cast("timestamp"), "E").substr(1, 3),
        F.date_format(F.col("ts").cast("timestamp"), " MMM dd HH:mm:ss '+0000' yyyy"),
    )
    key = F.col("event_id").cast("string")
    found = posts.extract_posts(single(events, key, json(post(key, F.col("event_type"), created_at=stamp))))
    return posts.with_created_ts(found).select("id", F.col("created_ts").cast("timestamp_ntz").alias("created_ts"))


# --- post fields -----------------------------------------------------------------


def _event_posts(spark, sf_dir, **options):
    events = spread_table(spark, sf_dir, "events")
    key = F.col("event_id").cast("string")
    return posts.extract_posts(single(events, key, json(post(key, F.col("event_type"), **options))))


@query(
    "authors",
    """SELECT CAST(event_id AS VARCHAR) AS id,
              CASE WHEN event_type = 'error' THEN 'Unknown User' ELSE 'u' || user_id END AS username,
              CASE WHEN event_type = 'view' THEN 'Unknown Name' ELSE 'Name ' || user_id END AS actual_name
       FROM events""",
)
def authors(spark, sf_dir):
    who = F.col("user_id").cast("string")
    found = _event_posts(
        spark,
        sf_dir,
        screen_name=F.when(F.col("event_type") == "error", "").otherwise(F.concat(F.lit("u"), who)),
        name=F.when(F.col("event_type") == "view", "").otherwise(F.concat(F.lit("Name "), who)),
    )
    return found.select("id", "username", "actual_name")


@query(
    "engagement",
    """SELECT CAST(event_id AS VARCHAR) AS id, event_id AS favourite_count, user_id AS reply_count,
              CAST(floor(value) AS BIGINT) AS retweet_count FROM events""",
)
def engagement(spark, sf_dir):
    found = _event_posts(
        spark,
        sf_dir,
        favorites=F.col("event_id"),
        replies=F.col("user_id").cast("string"),
        retweets=F.floor("value"),
    )
    return found.select("id", "favourite_count", "reply_count", "retweet_count")


@query(
    "entity_lists",
    """SELECT CAST(event_id AS VARCHAR) AS id,
              'https://e.org/' || event_id || '|https://e.org/' || user_id AS urls,
              'u' || user_id || '|admin' AS mentions, event_type AS hashtags FROM events""",
)
def entity_lists(spark, sf_dir):
    link = lambda c: url("https://t.co/1", F.concat(F.lit("https://e.org/"), F.col(c).cast("string")))
    found = _event_posts(
        spark,
        sf_dir,
        entities_=entities(
            urls=[link("event_id"), link("user_id")],
            mentions=[mention(F.concat(F.lit("u"), F.col("user_id").cast("string"))), mention("admin")],
            hashtags=[{"text": F.col("event_type")}],
        ),
    )
    return found.select("id", *[F.array_join(c, "|").alias(c) for c in ("urls", "mentions", "hashtags")])


@query(
    "quotes",
    """SELECT c.conv_id || '_' || c.turn AS id, m.conv_id || '_' || m.turn AS quoted_id, m.text AS quoted_text,
              m.role AS quoted_user, 'https://x.com/q/' || m.conv_id AS link
       FROM conversations c JOIN conversations m ON m.conv_id = c.conv_id AND m.turn = 0 WHERE c.turn > 0
       UNION ALL
       SELECT conv_id || '_' || turn, NULL, NULL, NULL, NULL FROM conversations WHERE turn = 0""",
)
def quotes(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations")
    quoted = json(turn_post())
    first = rows.where(F.col("turn") == 0).select("conv_id", quoted.alias("quoted"))
    joined = rows.join(first, "conv_id")
    own = json(turn_post(permalink=F.concat(F.lit("https://x.com/q/"), F.col("conv_id").cast("string"))))
    with_quote = F.concat(
        F.substring(own, F.lit(1), F.length(own) - 1),
        F.lit(',"quoted_status_result":{"result":'),
        F.col("quoted"),
        F.lit("}}"),
    )
    result = F.when(F.col("turn") > 0, with_quote).otherwise(own)
    found = posts.extract_posts(single(joined, turn_id(), result))
    q = F.col("quoted_tweet")
    return found.select(
        "id",
        q["id"].alias("quoted_id"),
        q["text"].alias("quoted_text"),
        q["username"].alias("quoted_user"),
        q["link"].alias("link"),
    )


def _binding(key, text=None, image=None):
    null = F.lit(None)
    shape = "struct<url:string,width:int,height:int>"
    value = F.struct(
        (null if text is None else text).cast("string").alias("string_value"),
        (null if image is None else image).cast(shape).alias("image_value"),
    )
    return F.struct(F.lit(key).alias("key"), value.alias("value"))


@query(
    "cards",
    """SELECT CAST(p_partkey AS VARCHAR) AS id, p_name AS title,
              CASE WHEN p_size > 25 THEN p_type ELSE '' END AS description, CAST(NULL AS VARCHAR) AS domain,
              'https://shop/' || p_partkey AS url,
              CASE WHEN p_size % 2 = 0 THEN 'https://img/' || p_partkey || '.png:' || p_size ELSE '' END AS images
       FROM part WHERE p_size <> 7
       UNION ALL SELECT CAST(p_partkey AS VARCHAR), NULL, NULL, NULL, NULL, NULL FROM part WHERE p_size = 7""",
)
def cards(spark, sf_dir):
    part = spread_table(spark, sf_dir, "part")
    key = F.col("p_partkey").cast("string")
    image = F.struct(
        F.when(F.col("p_size") % 2 == 0, F.concat(F.lit("https://img/"), key, F.lit(".png"))).alias("url"),
        F.col("p_size").alias("width"),
        F.col("p_size").alias("height"),
    )
    empty = F.col("p_size") == 7
    text = lambda c: F.when(~empty, c).otherwise("")
    bindings = F.array(
        _binding("title", text(F.col("p_brand"))),
        _binding("title", text(F.col("p_name"))),
        _binding("description", text(F.when(F.col("p_size") > 25, F.col("p_type")).otherwise(""))),
        _binding("card_url", text(F.concat(F.lit("https://shop/"), key))),
        _binding("photo_image_full_size_original", None, image),
    )
    card = obj(
        rest_id="card",
        legacy={
            "binding_values": bindings,
            "card_platform": {"platform": {"audience": {}, "device": {}}},
            "name": "summary",
            "url": "u",
            "user_refs_results": [],
        },
    )
    found = posts.extract_posts(single(part, key, json(post(key, F.col("p_name"), card=card))))
    c = F.col("card")
    shown = F.transform(
        c["images"], lambda i: F.concat_ws(":", i["url"], i["width"].cast("string"))
    )
    return found.select(
        "id",
        c["title"].alias("title"),
        c["description"].alias("description"),
        c["domain"].alias("domain"),
        c["url"].alias("url"),
        F.when(c.isNotNull(), F.array_join(shown, ",")).alias("images"),
    )


_STRIPPED = "trim(x, chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || ' ' || chr(160) || chr(8195) || chr(12288))"


@query(
    "articles",
    f"""SELECT CAST(doc_id AS VARCHAR) AS id,
               array_to_string(list_concat(['# ' || source, ''], list_filter(
                 list_transform(string_split(text, chr(10)), lambda x, i: CASE i % 9
                   WHEN 1 THEN '# ' || {_STRIPPED} WHEN 2 THEN '## ' || {_STRIPPED}
                   WHEN 3 THEN '### ' || {_STRIPPED} WHEN 4 THEN '• ' || {_STRIPPED}
                   WHEN 5 THEN '- ' || {_STRIPPED} WHEN 6 THEN '> ' || {_STRIPPED}
                   WHEN 7 THEN CASE i % 7
                     WHEN 0 THEN '![Media](https://img/a.jpg)'
                     WHEN 1 THEN chr(10) || 'code' || chr(10) WHEN 2 THEN chr(10) || '---' || chr(10)
                     WHEN 3 THEN '[Embedded Tweet: https://x.com/i/status/99]' WHEN 4 THEN '[POLL]'
                     WHEN 5 THEN '![Media](unknown)' ELSE '[UNKNOWN ELEMENT]' END
                   ELSE nullif({_STRIPPED}, '') END),
                 lambda y: y IS NOT NULL)), chr(10)) AS text
        FROM documents""",
)
def articles(spark, sf_dir):
    kinds = F.array(
        *[
            F.lit(k)
            for k in (
                "unstyled",
                "header-one",
                "header-two",
                "header-three",
                "unordered-list-item",
                "ordered-list-item",
                "blockquote",
                "atomic",
                "unstyled",
            )
        ]
    )
    lines = F.split("text", "\n")
    blocks = F.transform(
        lines,
        lambda x, i: F.struct(
            F.lit("k").alias("key"),
            x.alias("text"),
            F.get(kinds, (i + 1) % 9).alias("type"),
            F.array(F.struct(((i + 1) % 7).alias("key"))).alias("entityRanges"),
        ),
    )
    entity_map = F.lit(
        '[{"key":"0","value":{"type":"MEDIA","data":{"mediaItems":[{"mediaId":"m1"}]}}},'
        '{"key":"1","value":{"type":"MARKDOWN","data":{"markdown":"code"}}},'
        '{"key":"2","value":{"type":"DIVIDER","data":{}}},'
        '{"key":"3","value":{"type":"TWEET","data":{"tweetId":"99"}}},'
        '{"key":"4","value":{"type":"POLL","data":{}}},'
        '{"key":"5","value":{"type":"MEDIA","data":{"mediaItems":[]}}}]'
    )
    media = F.lit(
        '[{"id":"i","media_key":"k","media_id":"m1","media_info":'
        '{"__typename":"ApiImage","original_img_url":"https://img/a.jpg"}}]'
    )
    body = F.concat(
        F.lit('{"article_results":{"result":{"rest_id":"1","id":"1","title":"'),
        F.col("source"),
        F.lit('","content_state":{"blocks":'),
        F.to_json(blocks),
        F.lit(',"entityMap":'),
        entity_map,
        F.lit('},"media_entities":'),
        media,
        F.lit("}}}"),
    )
    key = F.col("doc_id").cast("string")
    own = json(post(key, "see article"))
    result = F.concat(F.substring(own, F.lit(1), F.length(own) - 1), F.lit(',"article":'), body, F.lit("}"))
    found = posts.extract_posts(single(spread_table(spark, sf_dir, "documents"), key, result))
    return found.select("id", "text")


# --- transcript, validation, captures ----------------------------------------------


@query(
    "transcript",
    """SELECT CAST(conv_id AS VARCHAR) AS conv_id,
              CAST(turn // 64 AS INTEGER) AS part,
              coalesce(max(CASE WHEN turn = 0 THEN 'Main Tweet by ' || role || ':' || chr(10) || text || chr(10) END), '')
              || chr(10) || 'Replies:' || chr(10)
              || string_agg(CASE WHEN turn > 0 THEN '- ' || role || ': ' || text || chr(10) ELSE '' END
                            || '- : [No tweet text available]', chr(10) ORDER BY turn) AS transcript
       FROM conversations GROUP BY conv_id, turn // 64""",
)
def transcripts(spark, sf_dir):
    return transcript.render_transcript(_thread(spark, sf_dir, extra=True)).select("conv_id", "part", "transcript")


def _damaged(spark, sf_dir):
    """Orders as posts: F is whole, O lacks a field, P lacks it inside a wrapper."""
    orders = spread_table(spark, sf_dir, "orders")
    key = F.col("o_orderkey").cast("string")
    whole = json(post(key, F.col("o_orderpriority")))
    lacking = F.replace(whole, F.lit('"source":"web",'), F.lit(""))
    inner = F.replace(lacking, F.lit('"__typename":"Tweet",'), F.lit(""))
    wrapped = F.concat(F.lit('{"__typename":"TweetWithVisibilityResults","tweet":'), inner, F.lit("}"))
    status = F.col("o_orderstatus")
    return single(orders, key, F.when(status == "F", whole).when(status == "O", lacking).otherwise(wrapped))


@query(
    "validation",
    """SELECT CAST(o_orderkey AS VARCHAR) AS conv_id, o_orderstatus <> 'P' AS is_valid,
              CASE WHEN o_orderstatus = 'P' THEN 'invalid post' END AS reason FROM orders""",
)
def validation(spark, sf_dir):
    return validate.validation_status(_damaged(spark, sf_dir))


@query(
    "validation_paths",
    """SELECT CAST(o_orderkey AS VARCHAR) AS conv_id, 'result.tweet.source' AS violations
       FROM orders WHERE o_orderstatus = 'P'""",
)
def validation_paths(spark, sf_dir):
    _, bad = validate.validate_conversations(_damaged(spark, sf_dir))
    return bad.select("conv_id", F.array_join("violations", ",").alias("violations"))


def capture_rows(spark, sf_dir, result_json=None, per_capture=3):
    """Each conversation in captures of up to three turns."""
    rows = table(spark, sf_dir, "conversations").withColumn("capture_no", F.expr(f"cast(turn div {per_capture} as int)"))
    body = item(json(turn_post()) if result_json is None else result_json)
    one = F.when(F.col("turn") == 0, entry(F.concat(F.lit("tweet-"), turn_id()), body)).otherwise(
        module_entry(F.concat(F.lit("conversationthread-"), turn_id()), body)
    )
    entries_ = F.array_sort(F.collect_list(F.struct("turn", one.alias("entry"))))
    return (
        rows.groupBy(F.col("conv_id").cast("string").alias("conv_id"), "capture_no")
        .agg(F.transform(entries_, lambda e: e["entry"]).alias("entries"))
        .select(
            "conv_id",
            "capture_no",
            F.concat(F.lit('{"data":'), document(F.array_join("entries", ",")), F.lit("}")).alias("raw"),
        )
    )


@query(
    "capture_entries",
    """SELECT CAST(conv_id AS VARCHAR) AS conv_id, turn // 3 AS capture_no, turn % 3 AS entry_pos,
              CASE WHEN turn = 0 THEN 'tweet-' ELSE 'conversationthread-' END || conv_id || '_' || turn AS entry_id
       FROM conversations""",
)
def capture_entries(spark, sf_dir):
    found = captures.capture_entries(capture_rows(spark, sf_dir))
    return found.select(
        "conv_id",
        F.col("capture_no").cast("bigint").alias("capture_no"),
        F.col("entry_pos").cast("bigint").alias("entry_pos"),
        F.get_json_object("entry", "$.entryId").alias("entry_id"),
    )


@query(
    "merge_pages",
    """SELECT CAST(conv_id AS VARCHAR) AS conv_id, CAST(turn // 192 AS INTEGER) AS part,
              string_agg(CASE WHEN turn = 0 THEN 'tweet-' ELSE 'conversationthread-' END || conv_id || '_' || turn,
                         ',' ORDER BY turn) AS entry_ids
       FROM conversations GROUP BY conv_id, turn // 192""",
)
def merge_pages(spark, sf_dir):
    merged = captures.merge_capture_pages(capture_rows(spark, sf_dir))
    ddl = (
        "struct<threaded_conversation_with_injections_v2:struct<instructions:"
        "array<struct<entries:array<struct<entryId:string>>>>>>"
    )
    found = F.get(
        F.from_json("raw", ddl)["threaded_conversation_with_injections_v2"]["instructions"], F.lit(0)
    )["entries"]
    return merged.select(
        "conv_id", "part", F.array_join(F.transform(found, lambda e: e["entryId"]), ",").alias("entry_ids")
    )
