"""Long-form articles rendered as markdown text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from marklake.functions.index import evaluated_once, index_of
from marklake.functions.scalars import status_url
from marklake.functions.text import strip

# Markdown put before the text of a block, by block type.
BLOCK_PREFIXES = {
    "header-one": "# ",
    "header-two": "## ",
    "header-three": "### ",
    "unordered-list-item": "• ",
    "ordered-list-item": "- ",
    "blockquote": "> ",
}


def _index(article: Column) -> Column:
    """Entities by key (the first of equal ones), media ids by key and addresses by media id (the last usable ones)."""
    entry = lambda key, value: F.struct(key.alias("key"), value.alias("value"))
    # The address: the picture, or a video's still.
    url = lambda m: F.when(m["kind"] == "ApiImage", m["image_url"]).when(
        m["kind"] == "ApiVideo", m["preview_url"]
    )
    usable = F.filter(
        article["media"],
        lambda m: url(m).isNotNull() & ((m["kind"] == "ApiVideo") | (url(m) != "")),
    )
    shown = F.filter(article["entities"], lambda e: (e["type"] == "MEDIA") & (e["n_items"] > 0))
    return F.struct(
        index_of(F.transform(article["entities"], lambda e: entry(e["key"], e)), last=False).alias("entities"),
        index_of(F.transform(shown, lambda e: entry(e["key"], e["media_id"]))).alias("media_ids"),
        index_of(F.transform(usable, lambda m: entry(m["media_id"], url(m)))).alias("urls"),
    )


def _embedded(index: Column, key: Column) -> Column:
    """Text of the entity an atomic block points at."""
    entity = F.try_element_at(index["entities"], key)
    media_id = F.coalesce(F.try_element_at(index["media_ids"], key), F.lit(""))

    def render(e: Column) -> Column:
        kind = e["type"]
        url = F.coalesce(F.try_element_at(index["urls"], media_id), F.lit(""))
        picture = F.concat(F.lit("![Media]("), F.when(url != "", url).otherwise(F.lit("unknown")), F.lit(")"))
        code = F.when(
            e["markdown"] != "", F.concat(F.lit("\n"), e["markdown"], F.lit("\n"))
        ).otherwise(F.lit("[CODE SNIPPET]"))
        post = F.when(
            e["post_id"] != "",
            F.concat(F.lit("[Embedded Tweet: "), status_url(e["post_id"]), F.lit("]")),
        ).otherwise(F.lit("[Embedded Tweet]"))
        return (
            F.when(kind == "MEDIA", picture)
            .when(kind == "MARKDOWN", code)
            .when(kind == "DIVIDER", F.lit("\n---\n"))
            .when(kind == "TWEET", post)
            .otherwise(F.concat(F.lit("["), kind, F.lit("]")))
        )

    return evaluated_once(entity, lambda e: F.when(e.isNull(), F.lit("[UNKNOWN ELEMENT]")).otherwise(render(e)))


def render_article(article: Column) -> Column:
    """Markdown of an article struct; title and preview when it has no body."""

    def block_line(index: Column, b: Column) -> Column:
        text = strip(b["text"])
        line = F.when(b["type"] == "atomic", F.when(b["has_range"], _embedded(index, b["entity_key"])))
        for kind, prefix in BLOCK_PREFIXES.items():
            line = line.when(b["type"] == kind, F.concat(F.lit(prefix), text))
        return line.when(text != "", text)

    lines = evaluated_once(_index(article), lambda ix: F.transform(article["blocks"], lambda b: block_line(ix, b)))
    body = F.array_join(
        F.concat(F.array(F.concat(F.lit("# "), article["title"]), F.lit("")), F.array_compact(lines)), "\n"
    )
    short = F.concat(
        article["title"], F.lit("\n\n"), F.coalesce(article["preview_text"], F.lit(""))
    )
    return F.when(article["has_body"], body).otherwise(short)
