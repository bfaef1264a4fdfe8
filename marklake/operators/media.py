"""Downloadable media of posts: listing, best variant, length limit, storage keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marklake.functions.joins import as_lookup
from marklake.functions.reuse import once_per_jvm
from marklake.functions.scalars import (
    DEFAULT_CONTENT_TYPE,
    content_type,
    media_key,
    short_id,
    whole_seconds,
)

MEDIA_DDL = (
    "struct<tweet_id:string,media_id:string,media_url:string,thumbnail_url:string,"
    "media_type:string,media_duration:bigint,text:string>"
)

# Fixed value: query string that asks for a picture in full size.
ORIGINAL_SIZE = "?name=orig"


def best_variant(variants: Column) -> Column:
    """Variant with the highest bitrate; null counts as 0, the first of equals wins."""
    ranked = F.array_sort(
        F.transform(
            variants,
            lambda v, i: F.struct(
                (-F.coalesce(v["bitrate"], F.lit(0))).alias("back"), i.alias("pos"), v.alias("variant")
            ),
        )
    )
    return F.get(ranked, F.lit(0))["variant"]


def within_limit(millis: Column, limit: int | None) -> Column:
    """Does a video of this length pass? No limit passes everything."""
    return F.lit(True) if limit is None else whole_seconds(millis) <= limit


def _item(tweet_id, media_id, url, kind, thumbnail=None, duration=None) -> Column:
    null = F.lit(None).cast("string")
    return F.struct(
        tweet_id.alias("tweet_id"),
        media_id.alias("media_id"),
        url.alias("media_url"),
        (null if thumbnail is None else thumbnail).alias("thumbnail_url"),
        kind.alias("media_type"),
        (F.lit(None) if duration is None else duration).cast("bigint").alias("media_duration"),
        null.alias("text"),
    ).cast(MEDIA_DDL)


def post_media(
    post,
    *,
    thumbnails: bool = False,
    videos: bool = True,
    images: bool = True,
    card_images: bool = True,
    video_length_limit: int | None = 30,
) -> Column:
    """Array of the media of one extracted post, in listing order.

    Attached media, card pictures, the quoted post's media, article media.
    """

    def timed(tweet_id, media_id, variants, millis, kind, thumbnail) -> Column:
        ok = (F.coalesce(F.size(variants), F.lit(0)) > 0) & within_limit(millis, video_length_limit)
        item = _item(
            tweet_id,
            media_id,
            best_variant(variants)["url"],
            kind,
            thumbnail if thumbnails else None,
            whole_seconds(millis),
        )
        return F.when(ok, item)

    def attached(items: Column, tweet_id: Column) -> Column:
        def one(m: Column) -> Column:
            full = F.concat(m["media_url_https"], F.lit(ORIGINAL_SIZE))
            info = m["video_info"]
            photo = _item(tweet_id, m["id_str"], full, F.lit("image"))
            video = timed(
                tweet_id, m["id_str"], info["variants"], info["duration_millis"], m["type"], full
            )
            return F.when((m["type"] == "photo") & F.lit(images), photo).when(
                ((m["type"] == "video") | (m["type"] == "animated_gif")) & F.lit(videos), video
            )

        return F.array_compact(F.transform(items, one))

    def article(items: Column, tweet_id: Column) -> Column:
        def one(a: Column) -> Column:
            picture = F.when(
                F.coalesce(F.length(a["image_url"]), F.lit(0)) > 0,
                _item(tweet_id, a["media_id"], a["image_url"], F.lit("image")),
            )
            video = timed(
                tweet_id,
                a["media_id"],
                a["variants"],
                a["duration_millis"],
                F.lit("video"),
                a["preview_url"],
            )
            return F.when((a["kind"] == "ApiImage") & F.lit(images), picture).when(
                (a["kind"] == "ApiVideo") & F.lit(videos), video
            )

        return F.array_compact(F.transform(items, one))

    none = F.array().cast(f"array<{MEDIA_DDL}>")
    quoted = post["quoted_tweet"]
    lists = [attached(post["media"], post["id"])]
    if card_images:
        lists.append(
            F.transform(
                post["card"]["images"],
                lambda g, i: _item(
                    post["id"],
                    short_id(post["id"], g["url"], i.cast("string")),
                    g["url"],
                    F.lit("card_image"),
                ),
            )
        )
    lists.append(attached(quoted["media"], quoted["id"]))
    lists.append(article(post["article_media"], post["id"]))
    return F.concat(*[F.coalesce(items, none) for items in lists])


_POST_FIELDS = ("id", "media", "card", "quoted_tweet", "article_media")


def _row_media(limit: int | None, flags: dict) -> Column:
    """Media array over the columns of a post row."""
    return once_per_jvm(
        ("row media", limit, tuple(sorted(flags.items()))),
        lambda: post_media(
            {name: F.col(name) for name in _POST_FIELDS}, video_length_limit=limit, **flags
        ),
    )


def attach_media(posts: DataFrame, *, video_length_limit: int | None = None, **flags) -> DataFrame:
    """Posts with their media as an ``extracted_media`` array; no length limit by default."""
    return posts.withColumn("extracted_media", _row_media(video_length_limit, flags))


def media_candidates(
    posts: DataFrame, *, video_length_limit: int | None = 30, **flags
) -> DataFrame:
    """One row per downloadable media item of ``posts``, with its post and place in it."""
    keys = [c for c in ("conv_id", "part", "pos") if c in posts.columns]
    found = _row_media(video_length_limit, flags)
    return (
        posts.select(*keys, F.posexplode_outer(found).alias("media_pos", "item"))
        .where(F.col("media_pos").isNotNull())
        .select(*keys, "media_pos", "item.*")
    )


def media_storage_keys(media: DataFrame, bucket: str) -> DataFrame:
    """Add ``key``, ``location`` and ``content_type`` to media rows."""
    keyed = media.withColumn(
        "key", media_key(F.col("tweet_id"), F.col("media_id"), F.col("media_url"))
    )
    return keyed.withColumn(
        "location", F.concat(F.lit(f"s3://{bucket}/"), F.col("key"))
    ).withColumn(
        "content_type", F.coalesce(content_type(F.col("key")), F.lit(DEFAULT_CONTENT_TYPE))
    )


def explode_media(extracted: DataFrame) -> DataFrame:
    """Media rows of extracted conversations, main post first."""
    none = F.array()
    of_replies = F.flatten(
        F.transform(F.coalesce("replies", none), lambda r: F.coalesce(r["extracted_media"], none))
    )
    every = F.concat(F.coalesce(F.col("main_tweet.extracted_media"), none), of_replies)
    keys = [c for c in ("conv_id", "part") if c in extracted.columns]
    return (
        extracted.select(*keys, F.posexplode_outer(every).alias("media_pos", "item"))
        .where(F.col("media_pos").isNotNull())
        .select(*keys, "media_pos", "item.*")
    )


def _listed(documents: DataFrame, ids: DataFrame) -> DataFrame:
    """Documents whose id is listed."""
    wanted = ids.select(F.col("tweet_id").alias("conv_id"))
    return documents.join(as_lookup(wanted), "conv_id", "left_semi")


def media_for_ids(extracted: DataFrame, ids: DataFrame) -> DataFrame:
    """Media of the extracted conversations whose id is listed, main post first.

    ``extracted(conv_id, main_tweet, replies)`` as a written table: the ids are
    reduced before the media are exploded. For raw documents see
    ``media_of_listed``.
    """
    return explode_media(_listed(extracted, ids))


def skip_stored_media(manifest: DataFrame, objects: DataFrame) -> DataFrame:
    """Manifest rows whose ``key`` is not yet stored with at least one byte."""
    stored = objects.where(F.col("length") > 0).select("key")
    return manifest.join(stored, "key", "left_anti")


def with_stored(manifest: DataFrame, objects: DataFrame) -> DataFrame:
    """Manifest rows with ``stored``: is there an object of at least one byte under ``key``?"""
    found = objects.where(F.col("length") > 0).select("key").distinct().withColumn("stored", F.lit(True))
    return manifest.join(found, "key", "left").withColumn("stored", F.coalesce("stored", F.lit(False)))


def stored_locations(
    results: DataFrame, position: str = "media_pos", per_list: int = 1000
) -> DataFrame:
    """Locations of stored media per post: ``tweet_id, list_no, locations``.

    Failed items are dropped and posts without any stored item are absent. List
    ``list_no`` of a post holds its items at the positions from ``list_no *
    per_list`` on, ``per_list`` of them at most, in that order: a rule that is
    the same for small and large posts. ``position`` is a whole number that is
    the item's own within its post, as manifests carry it.
    """
    list_no = F.expr(f"cast({position} div {per_list} as int)").alias("list_no")
    found = F.array_sort(F.collect_list(F.struct(F.col(position).alias("at"), "location")))
    return (
        results.where(F.coalesce(F.length("location"), F.lit(0)) > 0)
        .groupBy("tweet_id", list_no)
        .agg(F.transform(found, lambda f: f["location"]).alias("locations"))
    )


def media_of_listed(conversations: DataFrame, ids: DataFrame, **options) -> DataFrame:
    """``media_for_ids`` straight from raw documents: only the listed ones are parsed."""
    from marklake.operators.conversations import extract_conversations

    return explode_media(extract_conversations(_listed(conversations, ids), with_media=True, **options))
