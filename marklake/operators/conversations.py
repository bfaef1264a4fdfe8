"""Conversation documents: built inside the row, or regrouped from post rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marklake.functions.reuse import once_per_jvm
from marklake.functions.text import KEEP
from marklake.operators.documents import key_columns, resolve_documents
from marklake.operators.media import post_media
from marklake.operators.posts import POSITION_COLUMNS, post_struct


def conversations_from_resolved(
    resolved: DataFrame,
    mode: str = KEEP,
    *,
    with_media: bool = False,
    compat_hashtags: bool = False,
    **media_flags,
) -> DataFrame:
    """``key.., stage, reason, main_tweet, replies``, each row from its own input row.

    Documents that failed keep their row with null content.
    """
    media_flags.setdefault("video_length_limit", None)

    def build_posts() -> Column:
        posts = F.transform(
            "slots",
            lambda s: F.struct(
                s["role"].alias("role"), post_struct(s, mode, compat_hashtags).alias("post")
            ),
        )
        if not with_media:
            return posts
        return F.transform(
            posts,
            lambda p: p.withField("post.extracted_media", post_media(p["post"], **media_flags)),
        )

    flags = tuple(sorted(media_flags.items()))
    posts = once_per_jvm(("slot posts", mode, compat_hashtags, with_media, flags), build_posts)
    keys = key_columns(resolved)
    built = resolved.select(*keys, "stage", "reason", posts.alias("posts"))
    main = F.get(F.filter("posts", lambda p: p["role"] == "main"), F.lit(0))
    replies = F.transform(F.filter("posts", lambda p: p["role"] == "reply"), lambda p: p["post"])
    return built.select(
        *keys, "stage", "reason", main["post"].alias("main_tweet"), replies.alias("replies")
    )


def extract_conversations(
    conversations: DataFrame,
    mode: str = KEEP,
    *,
    strict: bool = False,
    with_media: bool = False,
    **options,
) -> DataFrame:
    """Raw documents to nested extracted conversations, without a shuffle."""
    built = conversations_from_resolved(
        resolve_documents(conversations, strict=strict), mode, with_media=with_media, **options
    )
    return built.where(F.col("stage").isNull()).drop("stage", "reason")


def assemble_conversations(
    posts: DataFrame, posts_per_document: int = 1000
) -> tuple[DataFrame, DataFrame]:
    """Regroup post rows into documents; returns ``(documents, failures)``.

    Document ``doc_no`` holds the posts of a row whose ``pos`` is from ``doc_no *
    posts_per_document`` on; ``part`` (where given) and ``doc_no`` belong to the key.
    The main post (the last main row) stands in the document it falls into, in
    the others it is null.
    Conversations without a main post go to the failures. Pass a written table:
    the posts are read once for the documents and once, three columns only, for
    the place of the last main post.
    """
    keys = key_columns(posts)
    fields = [c for c in posts.columns if c not in (*keys, *POSITION_COLUMNS)]
    row = F.struct("pos", F.struct(*fields).alias("post"))
    is_main = F.col("role") == "main"
    last_main = posts.groupBy("conv_id").agg(
        F.max(F.when(is_main, F.struct(*keys[1:], F.col("pos")))).alias("last_main")
    )
    documents = posts.groupBy(
        *keys, F.expr(f"cast(pos div {posts_per_document} as int)").alias("doc_no")
    ).agg(
        F.max_by(F.struct(*fields), F.when(is_main, F.col("pos"))).alias("main_tweet"),
        F.max(F.when(is_main, F.struct(*keys[1:], F.col("pos")))).alias("main_at"),
        F.transform(
            F.array_sort(
                F.collect_list(F.when(F.col("role") == "reply", row)), lambda a, b: a["pos"] - b["pos"]
            ),
            lambda r: r["post"],
        ).alias("replies"),
    )
    found = last_main.where(F.col("last_main").isNotNull())
    good = documents.join(found, "conv_id").select(
        *keys,
        "doc_no",
        F.when(F.col("main_at") == F.col("last_main"), F.col("main_tweet")).alias("main_tweet"),
        "replies",
    )
    failed = last_main.where(F.col("last_main").isNull()).select(
        "conv_id", F.lit("extract").alias("stage"), F.lit("no main post").alias("reason")
    )
    return good, failed
