"""Text functions on code points: strip, splice, link expansion."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The code points counted as white space when text is stripped.
WHITESPACE = "".join(
    chr(c)
    for c in (
        *range(0x09, 0x0E),
        *range(0x1C, 0x21),
        0x85,
        0xA0,
        0x1680,
        *range(0x2000, 0x200B),
        0x2028,
        0x2029,
        0x202F,
        0x205F,
        0x3000,
    )
)

KEEP, REPLACE, REMOVE = "keep", "replace", "remove"
MEDIA_URL_MODES = (KEEP, REPLACE, REMOVE)


def strip(text: Column) -> Column:
    """Drop Unicode white space at both ends (plain ``trim`` drops spaces only)."""
    return F.btrim(text, F.lit(WHITESPACE))


def splice(text: Column, start: Column, end: Column, put: Column) -> Column:
    """``text`` with the code points ``[start, end)`` replaced; ends past the text are clamped."""
    head = F.substring(text, F.lit(1), start.cast("int"))
    tail = F.substring(text, end.cast("int") + 1, F.lit(2147483647))
    return F.concat(head, put, tail)


def _edit_spans(text: Column, items: Column, put) -> Column:
    """Splice every item's span, from the last start to the first; equal starts keep their order."""
    ordered = F.array_sort(
        F.transform(
            items,
            lambda u, i: F.struct(
                (-F.get(u["indices"], F.lit(0))).alias("back"),
                i.alias("pos"),
                F.get(u["indices"], F.lit(0)).alias("start"),
                F.get(u["indices"], F.lit(1)).alias("end"),
                put(u).alias("put"),
            ),
        )
    )
    folded = F.aggregate(ordered, text, lambda acc, s: splice(acc, s["start"], s["end"], s["put"]))
    return F.when(F.size(items) > 0, folded).otherwise(text)


def expand_urls(text: Column, urls: Column) -> Column:
    """Put each link's long form over its span. ``urls``: array of (expanded_url, indices)."""
    return _edit_spans(text, urls, lambda u: u["expanded_url"])


def handle_media_urls(text: Column, media: Column, mode: str = KEEP) -> Column:
    """Keep, expand or remove the spans of attached media."""
    if mode not in MEDIA_URL_MODES:
        raise ValueError(f"mode must be one of {MEDIA_URL_MODES}, got {mode!r}")
    if mode == KEEP:
        return text
    put = (lambda m: m["expanded_url"]) if mode == REPLACE else (lambda m: F.lit(""))
    return _edit_spans(text, media, put)


def trim_trailing_urls(text: Column, urls: Column) -> Column:
    """Cut short links off the end, in list order, stripping after each cut."""
    cut = F.aggregate(
        F.coalesce(urls, F.array()),
        text,
        lambda acc, u: F.when(
            F.endswith(acc, u["url"]),
            strip(F.substring(acc, F.lit(1), F.length(acc) - F.length(u["url"]))),
        ).otherwise(acc),
    )
    return strip(F.when(F.size(urls) > 0, cut).otherwise(text))


def split_part(text: Column, separator: str, index: int) -> Column:
    """Piece ``index`` (from 0) of a split, null when there is none."""
    return F.get(F.split(text, separator), F.lit(index))
