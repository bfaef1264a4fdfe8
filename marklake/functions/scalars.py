"""Small scalar functions: dates, durations, media names, display strings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Content type by file extension.
CONTENT_TYPES = {
    "jpg": "image/jpeg",
    "jpeg": "image/jpeg",
    "png": "image/png",
    "gif": "image/gif",
    "mp4": "video/mp4",
    "webp": "image/webp",
}
DEFAULT_CONTENT_TYPE = "application/octet-stream"

MICROS_PER_DAY = 86_400_000_000


def webkit_date(micros: Column) -> Column:
    """Date of a count of microseconds since 1601-01-01, free of time zones."""
    whole = micros.try_cast("bigint")
    day = F.lit(MICROS_PER_DAY).cast("bigint")
    # Integer division: a double quotient would lose precision.
    days = F.call_function("div", whole - F.pmod(whole, day), day)
    return F.date_add(F.lit("1601-01-01").cast("date"), days.cast("int"))


def whole_seconds(millis: Column) -> Column:
    """Seconds rounded half to even; null counts as 0."""
    return F.coalesce(F.bround(millis / F.lit(1000.0), 0), F.lit(0.0)).cast("bigint")


def float_seconds(millis: Column) -> Column:
    return millis / F.lit(1000.0)


def status_url(post_id: Column) -> Column:
    return F.concat(F.lit("https://x.com/i/status/"), post_id)


def created_timestamp(created_at: Column) -> Column:
    """Timestamp of ``Wed Oct 10 20:19:24 +0000 2018``; null when it does not parse."""
    return F.try_to_timestamp(F.substring(created_at, 5, 100), F.lit("MMM dd HH:mm:ss Z yyyy"))


def url_path_name(url: Column) -> Column:
    """Last path segment of a URL, without query and fragment."""
    path = F.regexp_replace(url, r"[?#].*$", "")
    path = F.regexp_replace(path, r"^([A-Za-z][A-Za-z0-9+.\-]*:)?(//[^/]*)?", "")
    return F.substring_index(path, "/", -1)


def media_key(post_id: Column, media_id: Column, url: Column) -> Column:
    """Storage key ``{post_id}/{media_id}.{ext}``; no extension when the id or the URL rules it out."""
    name = url_path_name(url)
    extended = F.concat(media_id, F.lit("."), F.substring_index(name, ".", -1))
    file_name = F.when(
        ~F.contains(media_id, F.lit(".")) & F.contains(name, F.lit(".")), extended
    ).otherwise(media_id)
    return F.concat(post_id, F.lit("/"), file_name)


def content_type(key: Column) -> Column:
    """Content type from the extension of a storage key; null when it is not known."""
    extension = F.lower(F.substring_index(key, ".", -1))
    known = None
    for ext, kind in CONTENT_TYPES.items():
        hit = extension == ext
        known = F.when(hit, kind) if known is None else known.when(hit, kind)
    return F.when(F.contains(key, F.lit(".")), known)


def bookmark_label(name: Column, url: Column, date_added: Column) -> Column:
    return F.format_string("%s (%s) added on %s", name, url, date_added.cast("string"))


def short_id(*parts: Column) -> Column:
    """Eight hex digits that depend on nothing but the inputs."""
    return F.substring(F.sha2(F.concat_ws("#", *parts), 256), 1, 8)
