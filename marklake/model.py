"""Record model of a captured conversation.

The nested tables below state which fields a record must carry. From one
table come the ``from_json`` schema, the Boolean "is this record valid"
expression and the list of violated paths, so the three cannot drift apart.

Numbers and Booleans are parsed as text and coerced, because numeric text such
as ``"5"`` counts as a valid integer. With ``strict=True`` text fields are
parsed as VARIANT so that a number in a text field is told from text.
"""

from __future__ import annotations

from dataclasses import dataclass
from typing import Callable


@dataclass(frozen=True)
class Scalar:
    kind: str  # str | int | bool | dict | any


@dataclass(frozen=True)
class OneOf:
    values: tuple[str, ...]


@dataclass(frozen=True)
class NullableOneOf:
    """The key must be present; its value is null or one of ``values``."""

    values: tuple[str, ...]


@dataclass(frozen=True)
class ListOf:
    item: object


@dataclass(frozen=True)
class Opt:
    spec: object


@dataclass(frozen=True)
class Opaque:
    """Parsed with the given type and checked elsewhere."""

    ddl: Callable[[bool], str]


@dataclass(frozen=True)
class Checked:
    """A record with a rule across its fields."""

    fields: dict
    rule_name: str
    rule: Callable[[str], str]


STR, INT, BOOL, DICT, ANY = (Scalar(k) for k in ("str", "int", "bool", "dict", "any"))

# ---------------------------------------------------------------------------
# Field names, required/optional status and enum members.
# ---------------------------------------------------------------------------

USER_LEGACY = {
    "default_profile": BOOL,
    "default_profile_image": BOOL,
    "description": STR,
    "entities": DICT,
    "fast_followers_count": INT,
    "favourites_count": INT,
    "followers_count": INT,
    "friends_count": INT,
    "has_custom_timelines": BOOL,
    "is_translator": BOOL,
    "listed_count": INT,
    "media_count": INT,
    "normal_followers_count": INT,
    "pinned_tweet_ids_str": ListOf(STR),
}

USER = {
    "__typename": OneOf(("User",)),
    "id": STR,
    "rest_id": STR,
    "core": {"created_at": STR, "name": STR, "screen_name": STR},
    "legacy": USER_LEGACY,
}

MEDIA_SIZE = {"h": INT, "w": INT, "resize": STR}

VIDEO_VARIANT = {"content_type": STR, "url": STR, "bitrate": Opt(INT)}

MEDIA = {
    "display_url": STR,
    "expanded_url": STR,
    "id_str": STR,
    "indices": ListOf(INT),
    "media_key": STR,
    "media_url_https": STR,
    "type": OneOf(("photo", "video", "animated_gif")),
    "url": STR,
    "additional_media_info": Opt({"monetizable": BOOL}),
    "ext_media_availability": {"status": STR},
    "sizes": {"large": MEDIA_SIZE, "medium": MEDIA_SIZE, "small": MEDIA_SIZE, "thumb": MEDIA_SIZE},
    "original_info": {"height": INT, "width": INT, "focus_rects": ListOf(ANY)},
    "video_info": Opt(
        {"aspect_ratio": ListOf(INT), "duration_millis": Opt(INT), "variants": ListOf(VIDEO_VARIANT)}
    ),
}

URL = {"display_url": STR, "expanded_url": STR, "url": STR, "indices": ListOf(INT)}

MENTION = {"id_str": STR, "name": STR, "screen_name": STR, "indices": ListOf(INT)}

ENTITY_SET = {
    "user_mentions": ListOf(MENTION),
    "urls": ListOf(URL),
    "hashtags": ListOf(ANY),
    "symbols": ListOf(ANY),
}

POST_LEGACY = {
    "created_at": STR,
    "conversation_id_str": STR,
    "display_text_range": ListOf(INT),
    "entities": {"media": Opt(ListOf(MEDIA)), **ENTITY_SET},
    "extended_entities": Opt({"media": Opt(ListOf(MEDIA))}),
    "favorite_count": INT,
    "favorited": BOOL,
    "full_text": STR,
    "is_quote_status": BOOL,
    "lang": STR,
    "quote_count": INT,
    "quoted_status_permalink": Opt({"url": STR, "expanded": STR, "display": STR}),
    "reply_count": INT,
    "retweet_count": INT,
    "retweeted": BOOL,
}

NOTE = {"note_tweet_results": {"result": {"id": STR, "text": STR, "entity_set": ENTITY_SET}}}

USER_REF = Checked(
    {
        "__typename": OneOf(("User", "UserUnavailable")),
        "id": Opt(STR),
        "rest_id": Opt(STR),
        "affiliates_highlighted_label": Opt(DICT),
        "has_graduated_access": Opt(BOOL),
        "is_blue_verified": Opt(BOOL),
        "legacy": Opt(USER_LEGACY),
    },
    "user fields",
    lambda p: f"({p}.__typename <> 'User' OR ("
    + " AND ".join(
        f"{p}.{f} IS NOT NULL"
        for f in (
            "id",
            "rest_id",
            "affiliates_highlighted_label",
            "has_graduated_access",
            "is_blue_verified",
            "legacy",
        )
    )
    + "))",
)

BINDING_DDL = (
    "struct<string_value:string,image_value:struct<url:string,width:string,height:string,alt:string>>"
)

CARD = {
    "rest_id": STR,
    "legacy": Opt(
        {
            "binding_values": ListOf({"key": STR, "value": Opaque(lambda strict: BINDING_DDL)}),
            "card_platform": {"platform": {"audience": DICT, "device": DICT}},
            "name": STR,
            "url": STR,
            "user_refs_results": ListOf({"result": USER_REF}),
        }
    ),
}

ARTICLE_MEDIA_INFO = {
    "__typename": STR,
    "original_img_height": Opt(INT),
    "original_img_width": Opt(INT),
    "original_img_url": Opt(STR),
    "aspect_ratio": Opt({"numerator": INT, "denominator": INT}),
    "duration_millis": Opt(INT),
    "preview_image": Opt(
        {"original_img_url": STR, "original_img_height": INT, "original_img_width": INT}
    ),
    "variants": Opt(ListOf(VIDEO_VARIANT)),
}

ARTICLE_MEDIA = {"id": STR, "media_key": STR, "media_id": STR, "media_info": ARTICLE_MEDIA_INFO}

ENTITY_VALUE_DDL = (
    "struct<type:string,data:struct<mediaItems:array<struct<mediaId:string>>,"
    "markdown:string,tweetId:string>>"
)

ARTICLE = {
    "article_results": {
        "result": {
            "rest_id": STR,
            "id": STR,
            "title": STR,
            "preview_text": Opt(STR),
            "cover_media": Opt(ARTICLE_MEDIA),
            "content_state": Opt(
                {
                    "blocks": ListOf(
                        {
                            "key": STR,
                            "entityRanges": Opaque(lambda strict: "array<struct<key:string>>"),
                            "text": STR,
                            "type": STR,
                        }
                    ),
                    "entityMap": Opt(
                        ListOf({"key": STR, "value": Opaque(lambda strict: ENTITY_VALUE_DDL)})
                    ),
                }
            ),
            "media_entities": Opt(ListOf(ARTICLE_MEDIA)),
        }
    }
}

POST = {
    "rest_id": STR,
    "has_birdwatch_notes": BOOL,
    "core": {"user_results": {"result": USER}},
    "unmention_data": DICT,
    "edit_control": DICT,
    "is_translatable": BOOL,
    "views": DICT,
    "source": STR,
    "legacy": POST_LEGACY,
    "note_tweet": Opt(NOTE),
    "card": Opt(CARD),
    "article": Opt(ARTICLE),
}

TIMELINE_KINDS = ("TimelineTimelineItem", "TimelineTimelineModule", "TimelineTimelineCursor")
ITEM_KINDS = ("TimelineTweet", "TimelineTimelineModule", "TimelineTimelineCursor")
DISPLAY_KINDS = ("Tweet", "SelfThread")
INSTRUCTION_KINDS = ("TimelineAddEntries", "TimelineTerminateTimeline", "TimelineClearCache")

ROOT_KEY = "threaded_conversation_with_injections_v2"

# ---------------------------------------------------------------------------
# End of fixed values.
# ---------------------------------------------------------------------------


def _struct_ddl(fields: dict, strict: bool, extra: str = "") -> str:
    inner = ",".join(f"`{name}`:{ddl(spec, strict)}" for name, spec in fields.items())
    return f"struct<{inner}{',' + extra if extra else ''}>"


def ddl(spec, strict: bool = False) -> str:
    """Spark type of a spec, as a DDL string."""
    if isinstance(spec, dict):
        return _struct_ddl(spec, strict)
    if isinstance(spec, Checked):
        return _struct_ddl(spec.fields, strict)
    if isinstance(spec, Opt):
        return ddl(spec.spec, strict)
    if isinstance(spec, ListOf):
        return f"array<{ddl(spec.item, strict)}>"
    if isinstance(spec, Opaque):
        return spec.ddl(strict)
    if isinstance(spec, NullableOneOf):
        return "variant"
    if isinstance(spec, Scalar) and spec.kind == "str" and strict:
        return "variant"
    return "string"


def _post_ddl(strict: bool, quoted: str) -> str:
    return _struct_ddl(POST, strict, f"quoted_status_result:struct<result:{quoted}>" if quoted else "")


def result_ddl(strict: bool, depth: int = 1) -> str:
    """Type of a post union: the plain post's own fields, the wrapped post, the tombstone."""
    quoted = result_ddl(strict, depth - 1) if depth else ""
    post = _post_ddl(strict, quoted)
    return f"{post[:-1]},`__typename`:string,tombstone:variant,tweet:{post}>"


def _item_rule(lenient: bool) -> Callable[[str], str]:
    def rule(p: str) -> str:
        known = f"({p}.tweetDisplayType IS NULL OR {one_of(f'{p}.tweetDisplayType', DISPLAY_KINDS)})"
        if lenient:
            return f"({known} AND ({p}.itemType <> 'TimelineTweet' OR {p}.tweetDisplayType IS NOT NULL))"
        return (
            f"({known} AND ({p}.itemType = 'TimelineTimelineCursor' OR "
            f"({p}.tweet_results IS NOT NULL AND {p}.tweetDisplayType IS NOT NULL)))"
        )

    return rule


def _item(lenient: bool) -> Checked:
    return Checked(
        {
            "itemType": OneOf(ITEM_KINDS),
            "__typename": NullableOneOf(ITEM_KINDS),
            "tweetDisplayType": Opaque(lambda strict: "string"),
            "tweet_results": Opaque(lambda strict: f"struct<result:{result_ddl(strict)}>"),
        },
        "tweet_results and tweetDisplayType",
        _item_rule(lenient),
    )


ENTRY = Checked(
    {
        "entryId": STR,
        "sortIndex": STR,
        "content": {
            "entryType": OneOf(TIMELINE_KINDS),
            "__typename": OneOf(TIMELINE_KINDS),
            "itemContent": Opt(_item(lenient=False)),
            "items": Opt(
                ListOf(
                    {
                        "entryId": STR,
                        "item": {"itemContent": _item(lenient=True), "clientEventInfo": DICT},
                    }
                )
            ),
        },
    },
    "content of the entry kind",
    lambda p: f"((NOT startswith({{text:{p}.entryId}}, 'tweet-') OR {p}.content.itemContent IS NOT NULL) AND "
    f"(NOT startswith({{text:{p}.entryId}}, 'conversationthread-') OR {p}.content.items IS NOT NULL))",
)

INSTRUCTION = Checked(
    {"type": OneOf(INSTRUCTION_KINDS), "entries": Opt(ListOf(ENTRY))},
    "entries",
    lambda p: f"({p}.type <> 'TimelineAddEntries' OR {p}.entries IS NOT NULL)",
)

INSTRUCTIONS = ListOf(INSTRUCTION)


def conversation_ddl(strict: bool = False) -> str:
    return f"struct<`{ROOT_KEY}`:struct<instructions:{ddl(INSTRUCTIONS, strict)}>>"


# --- SQL text ---------------------------------------------------------------


def text(path: str, strict: bool) -> str:
    """Read a text leaf."""
    return f"try_variant_get({path}, '$', 'string')" if strict else path


def integer(path: str) -> str:
    """Read an integer leaf; whole-valued decimals count as integers."""
    return (
        f"coalesce(try_cast({path} AS BIGINT), "
        f"CASE WHEN try_cast({path} AS DOUBLE) % 1 = 0 THEN try_cast(try_cast({path} AS DOUBLE) AS BIGINT) END)"
    )


def _quoted(values) -> str:
    return ", ".join(f"'{v}'" for v in values)


def one_of(path: str, values) -> str:
    """``path IN (..)``, in terms that are several times as fast: Spark leaves its loop over the list by an exception."""
    return "(" + " OR ".join(f"{path} = '{v}'" for v in values) + ")"


_BOOL_WORDS = ("true", "false", "1", "0", "yes", "no", "on", "off", "t", "f", "y", "n")


def _rule_sql(rule: str, strict: bool) -> str:
    """Fill the ``{text:path}`` marks of a cross-field rule."""
    out, rest = "", rule
    while "{text:" in rest:
        head, tail = rest.split("{text:", 1)
        path, rest = tail.split("}", 1)
        out += head + text(path, strict)
    return out + rest


def _leaf_ok(path: str, spec, strict: bool) -> str:
    if isinstance(spec, OneOf):
        return f"coalesce({one_of(path, spec.values)}, false)"
    if isinstance(spec, NullableOneOf):
        value = f"try_variant_get({path}, '$', 'string')"
        return (
            f"coalesce({path} IS NOT NULL AND "
            f"(is_variant_null({path}) OR {let('kind', value, one_of('kind', spec.values))}), false)"
        )
    if isinstance(spec, Opaque):
        return "true"
    if spec.kind == "str" and strict:
        return f"coalesce(schema_of_variant({path}) = 'STRING', false)"
    if spec.kind == "int":
        # The common case first: reading a double costs several times as much.
        return f"(try_cast({path} AS BIGINT) IS NOT NULL OR coalesce(try_cast({path} AS DOUBLE) % 1 = 0, false))"
    if spec.kind == "bool":
        plain = one_of(path, ("true", "false"))
        return f"coalesce({plain} OR lower({path}) IN ({_quoted(_BOOL_WORDS)}), false)"
    if spec.kind == "dict":
        return f"coalesce(startswith({path}, '{{'), false)"
    if spec.kind == "any":
        return "true"
    return f"{path} IS NOT NULL"


def valid(path: str, spec, strict: bool = False, depth: int = 0) -> str:
    """Boolean SQL, never null: does the value at ``path`` satisfy ``spec``?"""
    if isinstance(spec, Opt):
        return f"({path} IS NULL OR {valid(path, spec.spec, strict, depth)})"
    if isinstance(spec, ListOf):
        item = valid(f"v{depth}", spec.item, strict, depth + 1)
        if item == "true":
            return f"{path} IS NOT NULL"
        return f"coalesce(forall({path}, v{depth} -> {item}), false)"
    if isinstance(spec, Checked):
        rule = _rule_sql(spec.rule(path), strict)
        return f"({valid(path, spec.fields, strict, depth)} AND {rule})"
    if isinstance(spec, dict):
        parts = [f"{path} IS NOT NULL"]
        parts += [valid(f"{path}.`{n}`", s, strict, depth) for n, s in spec.items()]
        return "(" + " AND ".join(p for p in parts if p != "true") + ")"
    return _leaf_ok(path, spec, strict)


def violations(path: str, spec, label: str, strict: bool = False, depth: int = 0) -> list[str]:
    """SQL terms, each an ``array<string>`` of the violated paths below ``label``."""
    if isinstance(spec, Opt):
        inner = violations(path, spec.spec, label, strict, depth)
        return [f"CASE WHEN {path} IS NOT NULL THEN {_joined(inner)} END"]
    if isinstance(spec, ListOf):
        inner = violations(f"w{depth}", spec.item, f"{label}[]", strict, depth + 1)
        missing = f"CASE WHEN {path} IS NULL THEN array('{label}') END"
        if not inner:
            return [missing]
        each = f"array_distinct(flatten(transform({path}, w{depth} -> {_joined(inner)})))"
        return [missing, each]
    if isinstance(spec, Checked):
        rule = f"CASE WHEN {path} IS NOT NULL AND NOT coalesce({_rule_sql(spec.rule(path), strict)}, true) "
        rule += f"THEN array('{label} ({spec.rule_name})') END"
        return violations(path, spec.fields, label, strict, depth) + [rule]
    if isinstance(spec, dict):
        inner = []
        for name, sub in spec.items():
            inner += violations(f"{path}.`{name}`", sub, f"{label}.{name}", strict, depth)
        return [f"CASE WHEN {path} IS NULL THEN array('{label}') ELSE {_joined(inner)} END"]
    ok = _leaf_ok(path, spec, strict)
    return [] if ok == "true" else [f"CASE WHEN NOT ({ok}) THEN array('{label}') END"]


def _joined(terms: list[str]) -> str:
    filled = ", ".join(f"coalesce({t}, array())" for t in terms)
    return f"cast(concat({filled}) AS array<string>)" if terms else "cast(array() AS array<string>)"


def let(name: str, value: str, body: str) -> str:
    """Evaluate ``value`` once and use it as ``name`` in ``body``.

    The last step of an aggregate over nothing: unlike ``transform`` it doesn't copy what ``body`` gives, which is most of a
    document where bodies stand in each other.
    """
    return f"aggregate(array(), {value}, ({name}, _none) -> {name}, {name} -> {body})"
