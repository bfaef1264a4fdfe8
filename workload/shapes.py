"""Raw payload strings built from the base tables.

The base tables hold no social JSON, so each shape writes the JSON text a
capture would hold; the operators under test then parse that text. Constant
fields are there because a record without them would not be valid.
"""

from __future__ import annotations

from json import dumps

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table dealt evenly, at every size.

    The payload text of a row is hundreds of times the row's own size, so the
    narrow rows are dealt before the text is built, whatever the file's splits.
    """
    return table(spark, sf_dir, name).repartition(int(spark.conf.get("spark.sql.shuffle.partitions")))


def obj(**fields) -> dict:
    """A JSON object; its values are columns, plain values, or again objects and lists."""
    return fields


def _lit(value) -> Column:
    return value if isinstance(value, Column) else F.lit(value)


def _leaf(value: Column) -> Column:
    """JSON text of a column of any type."""
    wrapped = F.to_json(F.struct(value.alias("v")))
    text = F.substring(wrapped, F.lit(6), F.length(wrapped) - 6)
    return F.coalesce(F.nullif(text, F.lit("")), F.lit("null"))


def _pieces(value) -> list[str | Column]:
    if isinstance(value, Column):
        return [_leaf(value)]
    if isinstance(value, dict):
        inner = [[dumps(k), ":", *_pieces(v)] for k, v in value.items()]
        opening, closing = "{", "}"
    elif isinstance(value, list):
        inner = [_pieces(v) for v in value]
        opening, closing = "[", "]"
    else:
        return [dumps(value)]
    out: list[str | Column] = [opening]
    for n, part in enumerate(inner):
        out += [",", *part] if n else part
    return [*out, closing]


def json(value) -> Column:
    """JSON text of a record: constant stretches are literals, only columns are converted."""
    merged: list[str | Column] = []
    for piece in _pieces(value):
        if isinstance(piece, str) and merged and isinstance(merged[-1], str):
            merged[-1] += piece
        else:
            merged.append(piece)
    return F.concat(*[_lit(m) for m in merged])


def user(screen_name, name) -> dict:
    return obj(
        user_results={
            "result": {
                "__typename": "User",
                "id": "VXNlcjox",
                "rest_id": "1",
                "core": {"created_at": "x", "name": name, "screen_name": screen_name},
                "legacy": {
                    "default_profile": True,
                    "default_profile_image": False,
                    "description": "",
                    "entities": {},
                    "fast_followers_count": 0,
                    "favourites_count": 1,
                    "followers_count": 2,
                    "friends_count": 3,
                    "has_custom_timelines": False,
                    "is_translator": False,
                    "listed_count": 0,
                    "media_count": 0,
                    "normal_followers_count": 2,
                    "pinned_tweet_ids_str": [],
                },
            }
        }
    )


def span(start, end) -> list:
    return [start, end]


def url(short, expanded, start=0, end=0) -> dict:
    return obj(url=short, expanded_url=expanded, display_url=expanded, indices=span(start, end))


def mention(screen_name) -> dict:
    return obj(id_str="1", name=screen_name, screen_name=screen_name, indices=span(0, 0))


def media(id_str, kind, expanded, https, start=0, end=0, video_info=None) -> dict:
    size = {"h": 1, "w": 1, "resize": "fit"}
    fields = dict(
        id_str=id_str,
        media_key=F.concat(F.lit("3_"), _lit(id_str)),
        type=kind,
        url=expanded,
        expanded_url=expanded,
        display_url=expanded,
        media_url_https=https,
        indices=span(start, end),
        ext_media_availability={"status": "Available"},
        sizes={"large": size, "medium": size, "small": size, "thumb": size},
        original_info={"height": 1, "width": 1, "focus_rects": []},
    )
    if video_info is not None:
        fields["video_info"] = video_info
    return obj(**fields)


def entities(urls=None, mentions=None, hashtags=None, media=None) -> dict:
    fields = dict(
        urls=[] if urls is None else urls,
        user_mentions=[] if mentions is None else mentions,
        hashtags=[] if hashtags is None else hashtags,
        symbols=[],
    )
    if media is not None:
        fields["media"] = media
    return obj(**fields)


def post(
    rest_id,
    text,
    screen_name="user",
    name="User",
    typename: str | None = "Tweet",
    created_at="Wed Oct 10 20:19:24 +0000 2018",
    favorites=0,
    replies=0,
    retweets=0,
    entities_=None,
    permalink=None,
    **extra,
) -> dict:
    legacy = dict(
        created_at=created_at,
        conversation_id_str=rest_id,
        display_text_range=span(0, F.length(_lit(text))),
        entities=entities() if entities_ is None else entities_,
        favorite_count=favorites,
        favorited=False,
        full_text=text,
        is_quote_status=False,
        lang="en",
        quote_count=0,
        reply_count=replies,
        retweet_count=retweets,
        retweeted=False,
    )
    if permalink is not None:
        legacy["quoted_status_permalink"] = obj(url=permalink, expanded=permalink, display=permalink)
    fields = {} if typename is None else {"__typename": typename}
    fields.update(
        rest_id=rest_id,
        has_birdwatch_notes=False,
        core=user(screen_name, name),
        unmention_data={},
        edit_control={},
        is_translatable=True,
        views={},
        source="web",
        legacy=obj(**legacy),
        **extra,
    )
    return obj(**fields)


def item(result_json: Column) -> Column:
    """JSON text of an itemContent around the JSON text of a post union (null: no result)."""
    return F.concat(
        F.lit('{"itemType":"TimelineTweet","__typename":"TimelineTweet","tweetDisplayType":"Tweet",'),
        F.lit('"tweet_results":'),
        F.when(result_json.isNull(), F.lit("{}")).otherwise(
            F.concat(F.lit('{"result":'), result_json, F.lit("}"))
        ),
        F.lit("}"),
    )


def entry(entry_id: Column, item_json: Column) -> Column:
    return F.concat(
        F.lit('{"entryId":"'),
        entry_id,
        F.lit('","sortIndex":"1","content":{"entryType":"TimelineTimelineItem",'),
        F.lit('"__typename":"TimelineTimelineItem","itemContent":'),
        item_json,
        F.lit("}}"),
    )


def module_entry(entry_id: Column, *item_json: Column) -> Column:
    items = [
        F.concat(
            F.lit('{"entryId":"i","item":{"clientEventInfo":{},"itemContent":'), i, F.lit("}}")
        )
        for i in item_json
    ]
    return F.concat(
        F.lit('{"entryId":"'),
        entry_id,
        F.lit('","sortIndex":"1","content":{"entryType":"TimelineTimelineModule",'),
        F.lit('"__typename":"TimelineTimelineModule","items":['),
        F.concat_ws(",", *items),
        F.lit("]}}"),
    )


CURSOR_ITEM = (
    '{"itemType":"TimelineTimelineCursor","__typename":"TimelineTimelineCursor"}'
)


def document(entries_json: Column) -> Column:
    """JSON text of a conversation around the joined JSON text of its entries."""
    return F.concat(
        F.lit('{"threaded_conversation_with_injections_v2":{"instructions":[{"type":"TimelineClearCache"},'),
        F.lit('{"type":"TimelineAddEntries","entries":['),
        entries_json,
        F.lit("]}]}}"),
    )


ENTRIES_PER_PART = 64


def join_entries(rows: DataFrame, key: str, order: str, entry_json: Column) -> DataFrame:
    """Raw documents of the rows of each key: ``conv_id, part, raw``.

    ``order`` is a whole number. A part takes the rows of one block of 64
    numbers, so a key with very many rows becomes many documents of bounded
    size instead of one that has to be built by a single task.
    """
    ordered = F.array_sort(F.collect_list(F.struct(order, entry_json.alias("entry"))))
    part = F.expr(f"cast({order} div {ENTRIES_PER_PART} as int)").alias("part")
    return (
        rows.groupBy(F.col(key).cast("string").alias("conv_id"), part)
        .agg(F.transform(ordered, lambda e: e["entry"]).alias("entries"))
        .select("conv_id", "part", document(F.array_join("entries", ",")).alias("raw"))
    )


def single(rows: DataFrame, conv_id: Column, result_json: Column) -> DataFrame:
    """One document per row that holds only its main post."""
    return rows.select(
        conv_id.cast("string").alias("conv_id"),
        document(entry(F.concat(F.lit("tweet-"), conv_id.cast("string")), item(result_json))).alias("raw"),
    )


def thread(conversations: DataFrame, result_json: Column, extra: bool = False) -> DataFrame:
    """Turn 0 is the main post, later turns are replies in module entries.

    ``extra`` adds a related entry, a cursor and an empty module per turn,
    all of which an extraction has to drop.
    """
    key = F.concat(F.col("conv_id").cast("string"), F.lit("-"), F.col("turn").cast("string"))
    main = entry(F.concat(F.lit("tweet-"), key), item(result_json))
    reply = module_entry(F.concat(F.lit("conversationthread-"), key), item(result_json))
    one = F.when(F.col("turn") == 0, main).otherwise(reply)
    if extra:
        one = F.concat_ws(
            ",",
            one,
            entry(F.concat(F.lit("tweetdetailrelatedtweets-"), key), item(result_json)),
            entry(F.concat(F.lit("cursor-bottom-"), key), F.lit(CURSOR_ITEM)),
        )
    return join_entries(conversations, "conv_id", "turn", one)


def turn_id() -> Column:
    return F.concat(F.col("conv_id").cast("string"), F.lit("_"), F.col("turn").cast("string"))


def turn_post(text: Column | None = None, **options) -> dict:
    return post(
        turn_id(),
        F.col("text") if text is None else text,
        screen_name=F.col("role"),
        name=F.initcap("role"),
        **options,
    )
