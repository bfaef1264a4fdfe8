"""Link-preview cards: key/value bindings pivoted into one struct."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: the binding that carries the full-size picture.
IMAGE_KEY = "photo_image_full_size_original"

CARD_DDL = (
    "struct<title:string,description:string,domain:string,url:string,"
    "images:array<struct<alt:string,url:string,width:bigint,height:bigint>>>"
)


def extract_card(bindings: Column) -> Column:
    """Struct (title, description, domain, url, images), or null when all of it is empty.

    ``bindings``: array of (key, value(string_value, image_value)). A key that
    occurs more than once counts with its last value; every picture counts.
    """

    def last(key: str) -> Column:
        found = F.filter(bindings, lambda b: b["key"] == key)
        return F.try_element_at(found, F.lit(-1))["value"]["string_value"]

    title, description, domain, url = (last(k) for k in ("title", "description", "domain", "card_url"))
    pictures = F.filter(
        bindings,
        lambda b: (b["key"] == IMAGE_KEY) & b["value"]["image_value"]["url"].isNotNull(),
    )
    images = F.transform(
        pictures,
        lambda b: F.struct(
            F.coalesce(b["value"]["image_value"]["alt"], F.lit("")).alias("alt"),
            b["value"]["image_value"]["url"].alias("url"),
            F.coalesce(b["value"]["image_value"]["width"].try_cast("bigint"), F.lit(0)).alias("width"),
            F.coalesce(b["value"]["image_value"]["height"].try_cast("bigint"), F.lit(0)).alias("height"),
        ),
    )
    card = F.struct(
        title.alias("title"),
        description.alias("description"),
        domain.alias("domain"),
        url.alias("url"),
        images.alias("images"),
    ).cast(CARD_DDL)
    filled = F.size(images) > 0
    for part in (title, description, domain, url):
        filled = filled | (F.coalesce(F.length(part), F.lit(0)) > 0)
    return F.when(bindings.isNotNull() & filled, card)
