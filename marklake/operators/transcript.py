"""Plain-text threads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marklake.functions.reuse import once_per_jvm
from marklake.functions.text import strip, trim_trailing_urls
from marklake.operators.documents import key_columns, main_slot, resolve_documents
from marklake.operators.posts import NO_USER, PLACEHOLDERS

# Fixed value: the text of a thread with nothing to show.
EMPTY_THREAD = "[No content available]"


def _screen_name(post: Column) -> Column:
    return F.when(post["screen_name"] == "", F.lit(NO_USER)).otherwise(post["screen_name"])


def _said(slot: Column) -> tuple[Column, Column]:
    """Text and user of a slot; stand-ins have no user."""
    post, status = slot["post"], slot["status"]
    is_post = status == "post"
    placeholder = F.create_map(*[F.lit(x) for kv in PLACEHOLDERS.items() for x in kv])
    text = F.when(
        is_post & post["note"].isNotNull(), post["note"]["text"]
    ).when(is_post, trim_trailing_urls(post["full_text"], post["urls"])).otherwise(placeholder[status])
    return text, F.when(is_post, _screen_name(post)).otherwise(F.lit(""))


def _quote_lines(slot: Column, lead: str, indent: str) -> Column:
    quoted = slot["quote"]["post"]
    link = slot["post"]["permalink"]
    lines = F.array(
        F.concat(F.lit(f"{lead}Quoting @"), _screen_name(quoted), F.lit(":")),
        F.concat(F.lit(indent), strip(quoted["full_text"])),
        F.when(
            F.coalesce(F.length(link), F.lit(0)) > 0,
            F.concat(F.lit(f"{indent}Link to quoted tweet: "), link),
        ),
    )
    return F.when(quoted.isNotNull(), F.array_compact(lines)).otherwise(
        F.array().cast("array<string>")
    )


def render_transcript(conversations: DataFrame, *, strict: bool = False) -> DataFrame:
    """``key.., transcript`` of the valid documents, one text per input row."""
    resolved = resolve_documents(
        conversations, strict=strict, keep=("main", "reply", "cursor"), extraction=False
    )
    return resolved.where(F.col("stage").isNull()).select(
        *key_columns(resolved), once_per_jvm("transcript", _transcript).alias("transcript")
    )


def _transcript() -> Column:
    """Text of the array column ``slots``."""

    def main_lines(slot: Column) -> Column:
        text, user = _said(slot)
        header = F.array(F.concat(F.lit("Main Tweet by "), user, F.lit(":")), text)
        shown = (text != "") & (user != "")
        return F.when(shown, F.concat(header, _quote_lines(slot, "\n", "  ")))

    def reply_lines(slot: Column) -> Column:
        text, user = _said(slot)
        line = F.concat(F.lit("- "), user, F.lit(": "), text)
        return F.concat(F.array(line), _quote_lines(slot, "  ", "    "))

    none = F.array().cast("array<string>")
    head = F.coalesce(main_lines(main_slot(F.col("slots"))), none)
    replies = F.filter("slots", lambda s: s["role"].isin("reply", "cursor"))
    tail = F.when(
        F.size(replies) > 0,
        F.concat(F.array(F.lit("\nReplies:")), F.flatten(F.transform(replies, reply_lines))),
    ).otherwise(none)
    return F.get(
        F.transform(
            F.array(F.concat(head, tail)),
            lambda lines: F.when(F.size(lines) > 0, F.array_join(lines, "\n")).otherwise(
                F.lit(EMPTY_THREAD)
            ),
        ),
        F.lit(0),
    )
