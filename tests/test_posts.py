"""Post fields: text, spans, quotes, cards, articles, hashtags."""

import random

import pytest
from pyspark.sql import functions as F

from marklake.functions.text import expand_urls, handle_media_urls, strip
from marklake.operators.posts import extract_posts
from payloads import document, frame, main, media, note, post, reply, url, video

SPAN_DDL = "array<struct<expanded_url:string,indices:array<bigint>>>"


def splice(text, spans, put):
    """Plain restatement of the span rule."""
    for start, end, new in sorted(spans, key=lambda s: s[0], reverse=True):
        text = text[:start] + put(new) + text[end:]
    return text


def test_spans_match_brute_force(spark):
    rng = random.Random(5)
    rows = []
    for n in range(300):
        text = "".join(rng.choice("ab é😀 x") for _ in range(rng.randint(0, 30)))
        spans = []
        for _ in range(rng.randint(0, 4)):
            start = rng.randint(0, 35)
            spans.append((start, start + rng.randint(0, 8), rng.choice(["", "L😀NG", "https://e.org"])))
        rows.append((n, text, [(new, [start, end]) for start, end, new in spans]))
    df = spark.createDataFrame(rows, f"n int, text string, spans {SPAN_DDL}")
    found = df.select(
        "n",
        expand_urls(F.col("text"), F.col("spans")).alias("expanded"),
        handle_media_urls(F.col("text"), F.col("spans"), "remove").alias("removed"),
        handle_media_urls(F.col("text"), F.col("spans"), "keep").alias("kept"),
        strip(F.col("text")).alias("stripped"),
    ).collect()
    by_n = {r.n: r for r in found}
    for n, text, spans in rows:
        flat = [(i[0], i[1], new) for new, i in spans]
        assert by_n[n].expanded == splice(text, flat, lambda new: new)
        assert by_n[n].removed == splice(text, flat, lambda new: "")
        assert by_n[n].kept == text
        assert by_n[n].stripped == text.strip()


def test_strip_every_blank(spark):
    blanks = [chr(c) for c in range(0x3001) if chr(c).isspace()]
    rows = [(b, b + "x y" + b) for b in blanks] + [("​", "​x")]
    found = spark.createDataFrame(rows, "b string, t string").select("t", strip(F.col("t")).alias("s")).collect()
    assert all(r.s == r.t.strip() for r in found)


def test_mode_is_checked():
    with pytest.raises(ValueError):
        handle_media_urls(None, None, "drop")


@pytest.fixture(scope="module")
def rows(spark):
    span = 9  # "https://t" stands for a link in the texts below
    tag = {"text": "spark", "indices": [0, 1]}
    article = {
        "article_results": {
            "result": {
                "rest_id": "a", "id": "a", "title": "T", "preview_text": "P",
                "media_entities": [
                    {"id": "i", "media_key": "k", "media_id": "m1",
                     "media_info": {"__typename": "ApiImage", "original_img_url": "https://i/1"}},
                    {"id": "i", "media_key": "k", "media_id": "m2",
                     "media_info": {"__typename": "ApiVideo", "duration_millis": 2500,
                                    "preview_image": {"original_img_url": "https://i/2", "original_img_height": 1,
                                                      "original_img_width": 1},
                                    "variants": [{"content_type": "v", "url": "https://v/2", "bitrate": 1}]}},
                ],
            }
        }
    }
    entity = lambda key, kind, **data: {"key": key, "value": {"type": kind, "data": data}}
    block = lambda kind, text="", key=None: {
        "key": "b", "type": kind, "text": text, "entityRanges": [] if key is None else [{"key": key}]
    }
    full = {"article_results": {"result": {**article["article_results"]["result"], "content_state": {
        "blocks": [
            block("header-one", " H1 "), block("header-two", "H2"), block("header-three", "H3"),
            block("unordered-list-item", "u"), block("ordered-list-item", "o"), block("blockquote", "q"),
            block("unstyled", " plain　"), block("unstyled", "  "), block("odd", "odd"),
            block("atomic", "", 0), block("atomic", "", 1), block("atomic", "", 2), block("atomic", "", 3),
            block("atomic", "", 4), block("atomic", "", 5), block("atomic", "", 6), block("atomic", "", 7),
            block("atomic", "", 8), block("atomic", "", 99), block("atomic"),
        ],
        "entityMap": [
            entity("0", "MEDIA", mediaItems=[{"mediaId": "m1"}]), entity("1", "MEDIA", mediaItems=[{"mediaId": "m2"}]),
            entity("2", "MEDIA", mediaItems=[{"mediaId": "nope"}]), entity("3", "MARKDOWN", markdown="x = 1"),
            entity("4", "MARKDOWN"), entity("5", "DIVIDER"), entity("6", "TWEET", tweetId="77"),
            entity("7", "TWEET"), entity("8", "POLL"), entity("0", "DIVIDER"),
        ],
    }}}}
    binding = lambda key, **value: {"key": key, "value": value}
    card = lambda *bindings: {"rest_id": "c", "legacy": {
        "binding_values": list(bindings), "card_platform": {"platform": {"audience": {}, "device": {}}},
        "name": "n", "url": "u", "user_refs_results": []}}
    picture = "photo_image_full_size_original"
    docs = {
        "names": document(main(post("1", screen="", name=""))),
        "stripped_first": document(main(post("1", "  ab https://t", urls=[url("https://t", "LONG", 3, 3 + span)]))),
        "note": document(main(post("1", "short", note_tweet=note("  see https://t", [url("https://t", "LONG", 6, 15)])))),
        "drift": document(main(post("1", "a https://t https://m", urls=[url("https://t", "LONGER-LINK", 2, 11)],
                                    media_items=[media(start=12, end=21)]))),
        "tags": document(main(post("1", hashtags=[tag], mentions=["bob", "eve"]))),
        "videos": document(main(post("1", media_items=[
            media("a", "video", "same", video=video(1500)), media("b", "video", "same", video=video(2000)),
            media("c", "animated_gif", "gif", video=video(900)), media("d", "video", "none", video=video(None))]))),
        "short_article": document(main(post("1", article=article))),
        "article": document(main(post("1", note_tweet=note("ignored"), article=full))),
        "card": document(main(post("1", card=card(
            binding("title", string_value="first"), binding("title", string_value="second"),
            binding("domain", string_value="e.org"), binding(picture, image_value={"url": "https://i", "width": 3}),
            binding(picture, image_value={"width": 3}))))),
        "empty_card": document(main(post("1", card=card(binding("title", string_value=""))))),
        "bare_card": document(main(post("1", card={"rest_id": "c"}))),
        "quote": document(main(post("1", permalink="https://q", quoted_status_result={"result": post(
            "2", " q https://t ", screen="bob", urls=[url("https://t", "LONG", 2, 11)],
            media_items=[media("z", "video", "vz", video=video(500))], card=card(binding("title", string_value="t")))}))),
        "quote_link": document(main(post("1", permalink="https://q", quoted_status_result={"result": {}}))),
        "reply": document(main(post("1")), reply(post("2", "re", screen="bob"))),
    }
    raw = frame(spark, **docs)
    out = {r.conv_id: r for r in extract_posts(raw, "remove").where("role = 'main'").collect()}
    out["keep"] = {r.conv_id: r.text for r in extract_posts(raw, "keep", compat_hashtags=True).collect()}
    return out


def test_names(rows):
    assert (rows["names"].username, rows["names"].actual_name) == ("Unknown User", "Unknown Name")


def test_text_sources(rows):
    assert rows["stripped_first"].text == "ab LONG"
    assert rows["note"].text == "  see LONG"


def test_media_spans_use_original_places(rows):
    # The link grew by two characters, so the removed span is two characters early.
    assert rows["drift"].text == splice("a LONGER-LINK https://m", [(12, 21, "")], lambda n: n)
    assert rows["keep"]["drift"] == "a LONGER-LINK https://m"


def test_lists(rows):
    assert (rows["tags"].hashtags, rows["tags"].mentions) == (["spark"], ["bob", "eve"])
    assert rows["videos"].video_durations == {"same": 2.0}
    assert rows["videos"].media_urls == ["same", "same", "gif", "none"]


def test_article(rows):
    assert rows["short_article"].text == "T\n\nP"
    assert rows["article"].text.split("\n") == [
        "# T", "", "# H1", "## H2", "### H3", "• u", "- o", "> q", "plain", "odd",
        "![Media](https://i/1)", "![Media](https://i/2)", "![Media](unknown)", "", "x = 1", "", "[CODE SNIPPET]",
        "", "---", "", "[Embedded Tweet: https://x.com/i/status/77]", "[Embedded Tweet]", "[POLL]",
        "[UNKNOWN ELEMENT]",
    ]
    assert [m.media_id for m in rows["article"].article_media] == ["m1", "m2"]


def test_card(rows):
    card = rows["card"].card
    assert (card.title, card.description, card.domain, card.url) == ("second", None, "e.org", None)
    assert [(i.alt, i.url, i.width, i.height) for i in card.images] == [("", "https://i", 3, 0)]
    assert rows["empty_card"].card is None and rows["bare_card"].card is None


def test_quote(rows):
    quote = rows["quote"].quoted_tweet
    assert (quote.id, quote.text, quote.username, quote.link) == ("2", splice("q LONG", [(0, 0, "")], str), "bob", "https://q")
    assert quote.video_durations == {"vz": 0.5} and quote.media_urls == ["vz"]
    assert rows["quote_link"].quoted_tweet.link == "https://q"
