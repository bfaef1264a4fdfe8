"""Resolved slots to extracted posts, as rows or as an in-row array."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marklake.functions.index import index_of
from marklake.functions.reuse import once_per_jvm
from marklake.functions.scalars import created_timestamp, float_seconds
from marklake.functions.text import KEEP, expand_urls, handle_media_urls, strip
from marklake.operators.articles import render_article
from marklake.operators.cards import extract_card
from marklake.operators.documents import explode_slots, key_columns, resolve_documents

# Texts that stand in for posts that cannot be shown.
PLACEHOLDERS = {
    "missing": "[No tweet text available]",
    "tombstone": "[Tweet unavailable]",
    "unknown": "[Unknown tweet format]",
}
QUOTE_PLACEHOLDER = "[Quoted tweet unavailable]"
NO_USER, NO_NAME = "Unknown User", "Unknown Name"


def author_columns(post: Column) -> dict[str, Column]:
    """Screen name and display name; empty ones get a stand-in."""
    filled = lambda c, other: F.when(c == "", F.lit(other)).otherwise(c)
    return {
        "username": filled(post["screen_name"], NO_USER),
        "actual_name": filled(post["name"], NO_NAME),
    }


def _body_text(post: Column) -> Column:
    """Note text, else the stripped post text, with links expanded."""
    return F.when(
        post["note"].isNotNull(), expand_urls(post["note"]["text"], post["note"]["urls"])
    ).otherwise(expand_urls(strip(post["full_text"]), post["urls"]))


def select_text(post: Column) -> Column:
    """Article over note over post text; links are expanded in the latter two."""
    return F.when(post["article"].isNotNull(), render_article(post["article"])).otherwise(
        _body_text(post)
    )


def engagement_columns(post: Column) -> dict[str, Column]:
    zero = F.lit(0).cast("bigint")
    return {
        "favourite_count": F.coalesce(post["favorite_count"], zero),
        "reply_count": F.coalesce(post["reply_count"], zero),
        "retweet_count": F.coalesce(post["retweet_count"], zero),
    }


def _strings(col: Column) -> Column:
    return F.coalesce(col, F.array().cast("array<string>"))


def entity_columns(post: Column, compat_hashtags: bool = False) -> dict[str, Column]:
    """Long links, mentioned screen names and hashtags.

    ``compat_hashtags`` gives the always-empty hashtag lists of older exports.
    """
    tags = F.array_compact(F.transform(post["hashtags"], lambda h: F.get_json_object(h, "$.text")))
    return {
        "urls": _strings(F.transform(post["urls"], lambda u: u["expanded_url"])),
        "hashtags": F.array().cast("array<string>") if compat_hashtags else _strings(tags),
        "mentions": _strings(post["mentions"]),
    }


def media_url_columns(post: Column) -> dict[str, Column]:
    """Links of attached media, and seconds per video link (the last of equal links counts)."""
    timed = F.transform(
        F.filter(
            post["media"],
            lambda m: (m["type"] == "video") & m["video_info"]["duration_millis"].isNotNull(),
        ),
        lambda m: F.struct(
            m["expanded_url"].alias("key"),
            float_seconds(m["video_info"]["duration_millis"]).alias("value"),
        ),
    )
    durations = index_of(timed)
    return {
        "media_urls": _strings(F.transform(post["media"], lambda m: m["expanded_url"])),
        "video_durations": F.coalesce(
            durations, F.create_map().cast("map<string,double>")
        ),
    }


def extract_quote(
    quote: Column, permalink: Column, mode: str = KEEP, compat_hashtags: bool = False
) -> Column:
    """Struct of the quoted post, null when nothing is quoted.

    A quoted tombstone keeps a placeholder text and no link; a wrapper around
    nothing keeps the link of the quoting post.
    """
    post = quote["post"]
    found = (quote["status"] == "plain") | (quote["status"] == "wrapped")
    gone = quote["status"] == "tombstone"
    empty = F.lit("")

    def pick(value: Column, wrapper: Column = empty, tombstone: Column = empty) -> Column:
        return F.when(found, value).when(gone, tombstone).otherwise(wrapper)

    fields = {
        "id": pick(post["rest_id"]),
        "text": pick(
            handle_media_urls(_body_text(post), post["media"], mode), empty, F.lit(QUOTE_PLACEHOLDER)
        ),
    }
    names = author_columns(post)
    fields["username"] = pick(names["username"], F.lit(NO_USER))
    fields["actual_name"] = pick(names["actual_name"], F.lit(NO_NAME))
    fields["link"] = F.when(~gone, permalink)
    lists = {**entity_columns(post, compat_hashtags), **media_url_columns(post)}
    for name in ("urls", "media_urls", "video_durations", "hashtags", "mentions"):
        fields[name] = lists[name]
    fields["created_at"] = pick(post["created_at"])
    fields["media"] = F.coalesce(post["media"], F.array())
    return F.when(quote.isNotNull(), F.struct(*[c.alias(n) for n, c in fields.items()]))


def post_columns(
    slot: Column, mode: str = KEEP, compat_hashtags: bool = False
) -> dict[str, Column]:
    """The extracted post of a resolved slot, field by field.

    Slots without a post give a placeholder: empty id and names, zero counts,
    empty lists.
    """
    post, status = slot["post"], slot["status"]
    is_post = status == "post"
    placeholder = F.create_map(*[F.lit(x) for kv in PLACEHOLDERS.items() for x in kv])
    names = author_columns(post)
    lists = {**entity_columns(post, compat_hashtags), **media_url_columns(post)}
    blank = F.lit("")
    return {
        "id": F.when(is_post, post["rest_id"]).otherwise(blank),
        "text": F.when(
            is_post, handle_media_urls(select_text(post), post["media"], mode)
        ).otherwise(placeholder[status]),
        "username": F.when(is_post, names["username"]).otherwise(blank),
        "actual_name": F.when(is_post, names["actual_name"]).otherwise(blank),
        **engagement_columns(post),
        "urls": lists["urls"],
        "media_urls": lists["media_urls"],
        "video_durations": lists["video_durations"],
        "created_at": F.when(is_post, post["created_at"]).otherwise(blank),
        "quoted_tweet": extract_quote(slot["quote"], post["permalink"], mode, compat_hashtags),
        "card": extract_card(post["card"]),
        "hashtags": lists["hashtags"],
        "mentions": lists["mentions"],
        "media": F.coalesce(post["media"], F.array()),
        "article_media": F.coalesce(post["article"]["media"], F.array()),
    }


def post_struct(slot: Column, mode: str = KEEP, compat_hashtags: bool = False) -> Column:
    return F.struct(*[c.alias(n) for n, c in post_columns(slot, mode, compat_hashtags).items()])


POSITION_COLUMNS = ("pos", "instr_pos", "entry_pos", "item_pos", "role", "status")


def posts_from_resolved(
    resolved: DataFrame, mode: str = KEEP, compat_hashtags: bool = False
) -> DataFrame:
    """Explode resolved documents and extract one row per post."""
    slots = explode_slots(resolved).where(F.col("role").isin("main", "reply"))
    return slots.select(
        *key_columns(resolved), *POSITION_COLUMNS, *_row_columns(mode, compat_hashtags)
    )


def _row_columns(mode: str, compat_hashtags: bool) -> list[Column]:
    """Post columns over columns named ``post, status, quote``."""

    def build() -> list[Column]:
        slot = {name: F.col(name) for name in ("post", "status", "quote")}
        return [c.alias(n) for n, c in post_columns(slot, mode, compat_hashtags).items()]

    return once_per_jvm(("post columns", mode, compat_hashtags), build)


def extract_posts(
    conversations: DataFrame,
    mode: str = KEEP,
    *,
    strict: bool = False,
    compat_hashtags: bool = False,
) -> DataFrame:
    """One row per post of the good documents of ``conversations(conv_id, raw)``.

    ``role`` is ``main`` or ``reply``; ``pos`` numbers the posts of a document
    in document order. No shuffle: every row comes from one input row.
    """
    return posts_from_resolved(
        resolve_documents(conversations, strict=strict), mode, compat_hashtags
    )


def explode_entries(conversations: DataFrame, *, strict: bool = False) -> DataFrame:
    """Timeline items with position, role and outcome, before any text work."""
    return explode_slots(resolve_documents(conversations, strict=strict))


def with_created_ts(posts: DataFrame) -> DataFrame:
    """Add ``created_ts``, the timestamp of the textual ``created_at``."""
    return posts.withColumn("created_ts", created_timestamp(F.col("created_at")))
