"""Outcome of the post union in main, reply and quote position."""

import pytest

from marklake.operators.documents import resolve_documents
from marklake.operators.posts import extract_posts
from payloads import cursor, document, entry, frame, item, main, post, reply, without

WHOLE = post("7", "whole")
INNER = post("8", "inner", typename=None)
BROKEN = without(WHOLE, "source")
BROKEN_INNER = without(INNER, "source")

# result -> (status, text); None stands for an invalid document
UNION = {
    "plain": (WHOLE, ("post", "whole")),
    "wrapped": ({"__typename": "TweetWithVisibilityResults", "tweet": INNER}, ("post", "inner")),
    "wrapped_no_name": ({"tweet": INNER}, ("post", "inner")),
    "wrapped_user": ({"__typename": "UserUnavailable", "tweet": INNER}, ("post", "inner")),
    "named_tweet_wrapping": ({"__typename": "Tweet", "tweet": INNER}, ("post", "inner")),
    "tweet_bad_inner": ({"__typename": "Tweet", "tweet": BROKEN_INNER}, ("tombstone", "[Tweet unavailable]")),
    "tweet_tombstone_key": ({"__typename": "Tweet", "tombstone": None}, ("tombstone", "[Tweet unavailable]")),
    "bad_plain": (BROKEN, ("unknown", "[Unknown tweet format]")),
    "empty": ({}, ("unknown", "[Unknown tweet format]")),
    "user": ({"__typename": "UserUnavailable"}, ("unknown", "[Unknown tweet format]")),
    "tombstone": ({"__typename": "TweetTombstone"}, ("tombstone", "[Tweet unavailable]")),
    "visibility_empty": ({"__typename": "TweetWithVisibilityResults"}, None),
    "visibility_bad": ({"__typename": "TweetWithVisibilityResults", "tweet": BROKEN_INNER}, None),
    "no_name_bad": ({"tweet": BROKEN_INNER}, None),
    "user_bad": ({"__typename": "UserUnavailable", "tweet": BROKEN_INNER}, None),
    "strange": ({"__typename": "Promoted"}, None),
}


@pytest.fixture(scope="module")
def found(spark):
    docs = {}
    for name, (result, _) in UNION.items():
        docs[f"main_{name}"] = document(main(result))
        docs[f"reply_{name}"] = document(main(WHOLE), reply(result))
        docs[f"quote_{name}"] = document(main(post("1", "quoting", quoted_status_result={"result": result})))
    docs["main_missing"] = document(main("absent"))
    docs["main_null"] = document(main(None))
    docs["reply_missing"] = document(main(WHOLE), reply("absent"))
    docs["reply_null"] = document(main(WHOLE), reply(None))
    docs["cursor_main"] = document(entry("tweet-1", cursor()))
    docs["quote_none"] = document(main(post("1", "quoting", quoted_status_result={})))
    raw = frame(spark, **docs)
    resolved = {r.conv_id: r for r in resolve_documents(raw).drop("slots").collect()}
    posts = {}
    for r in extract_posts(raw).collect():
        posts.setdefault(r.conv_id, {})[r.role] = r
    return resolved, posts


@pytest.mark.parametrize("name", UNION)
def test_main_and_reply(found, name):
    resolved, posts = found
    expected = UNION[name][1]
    for role in ("main", "reply"):
        key = f"{role}_{name}"
        if expected is None:
            assert resolved[key].stage == "validate"
            assert key not in posts
        else:
            assert resolved[key].stage is None
            row = posts[key][role]
            assert (row.status, row.text) == expected
            assert (row.id == "") == (row.status != "post")


@pytest.mark.parametrize("name", UNION)
def test_quote(found, name):
    resolved, posts = found
    expected = UNION[name][1]
    key = f"quote_{name}"
    if expected is None:
        # The quoting plain post becomes invalid, which leaves an unknown format.
        assert posts[key]["main"].status == "unknown"
        return
    quote = posts[key]["main"].quoted_tweet
    status, text = expected
    if status == "post":
        assert quote.text == text and quote.username == "ann"
    elif status == "tombstone":
        assert (quote.id, quote.text, quote.username, quote.link) == ("", "[Quoted tweet unavailable]", "", None)
    else:
        assert (quote.id, quote.text, quote.username, quote.actual_name) == ("", "", "Unknown User", "Unknown Name")


def test_missing_results(found):
    resolved, posts = found
    # A main post needs a result; items of a thread do without.
    assert resolved["main_missing"].stage == "validate"
    assert resolved["main_null"].stage == "validate"
    for key in ("reply_missing", "reply_null"):
        assert posts[key]["reply"].text == "[No tweet text available]"
    assert posts["cursor_main"]["main"].text == "[No tweet text available]"
    assert posts["quote_none"]["main"].quoted_tweet is None


def test_placeholder_fields(found):
    row = found[1]["reply_missing"]["reply"]
    assert (row.id, row.username, row.actual_name, row.created_at) == ("", "", "", "")
    assert (row.favourite_count, row.reply_count, row.retweet_count) == (0, 0, 0)
    assert (row.urls, row.media_urls, row.video_durations, row.media) == ([], [], {}, [])
    assert row.card is None and row.quoted_tweet is None


def test_entries(spark):
    before = [{"type": "TimelineClearCache"}, {"type": "TimelineTerminateTimeline", "entries": [main(WHOLE)]}]
    docs = {
        "dropped": document(
            main(WHOLE),
            main(WHOLE, "tweetdetailrelatedtweets-1"),
            entry("cursor-bottom-1", cursor()),
            entry("conversationthread-2", item(post("9", "direct")), items=[]),
            entry("conversationthread-3", items=[item(results="none", display="Tweet"), item(post("10", "second"))]),
            before=before,
        ),
        "ancestors": document(main(post("1", "first")), main(post("2", "last"))),
        "no_main": document(reply(WHOLE)),
        "no_items": document(main(WHOLE), entry("conversationthread-9", item(WHOLE))),
        "no_item": document(main(WHOLE), entry("tweet-5", items=[])),
        "no_sort": document(main(WHOLE), without(reply(WHOLE), "sortIndex")),
        "no_entries": {"threaded_conversation_with_injections_v2": {"instructions": [{"type": "TimelineAddEntries"}]}},
        "bad_kind": document(main(WHOLE), before=[{"type": "Other"}]),
        "no_display": document(entry("tweet-1", item(WHOLE, display=None))),
        "no_key": document(entry("tweet-1", without(item(WHOLE), "__typename"))),
        "null_key": document(entry("tweet-1", {**item(WHOLE), "__typename": None})),
        "not_json": "{oops",
        "text_counts": document(main({**WHOLE, "legacy": {**WHOLE["legacy"], "favorite_count": "5"}})),
        "bad_counts": document(main({**WHOLE, "legacy": {**WHOLE["legacy"], "favorite_count": "five"}})),
        "video": document(main(post("1", "v", media_items=[_video()]))),
        "span": document(main(post("1", "v", urls=[{"url": "u", "expanded_url": "e", "display_url": "d", "indices": [1]}]))),
    }
    raw = frame(spark, **docs)
    reasons = {r.conv_id: (r.stage, r.reason) for r in resolve_documents(raw).drop("slots").collect()}
    rows = {}
    for r in extract_posts(raw).orderBy("conv_id", "pos").collect():
        rows.setdefault(r.conv_id, []).append((r.role, r.text, r.favourite_count))
    texts = lambda k: [(role, text) for role, text, _ in rows[k]]
    assert texts("dropped") == [("main", "whole"), ("reply", "direct"), ("reply", "second")]
    assert texts("ancestors") == [("main", "last")]
    assert reasons["no_main"] == ("extract", "no main post")
    for key in ("no_items", "no_item", "no_sort", "no_entries", "bad_kind", "no_display", "no_key"):
        assert reasons[key] == ("validate", "record shape"), key
    assert reasons["null_key"] == (None, None)
    assert reasons["not_json"] == ("validate", "unreadable document")
    assert rows["text_counts"][0][2] == 5
    assert rows["bad_counts"][0][1] == "[Unknown tweet format]"
    assert reasons["video"] == reasons["span"] == ("extract", "broken span or video")
    assert set(rows) == {k for k, (stage, _) in reasons.items() if stage is None}


def _video():
    from payloads import media

    return media(kind="video")


def test_strict_text(spark):
    numeric = {**WHOLE, "source": 5}
    raw = frame(spark, good=document(main(WHOLE)), numeric=document(main(numeric)))
    lax = {r.conv_id: r.status for r in extract_posts(raw).collect()}
    strict = {r.conv_id: (r.status, r.text) for r in extract_posts(raw, strict=True).collect()}
    assert lax == {"good": "post", "numeric": "post"}
    assert strict["good"] == ("post", "whole")
    assert strict["numeric"][0] == "unknown"


@pytest.mark.parametrize("strict", [True, False])
def test_documents_are_not_copied_from_step_to_step(strict):
    """Names are bound without a list around them, whose making copies the document; kinds are compared without lists."""
    from marklake.operators.documents import _resolved_sql

    sql = _resolved_sql(("main", "reply"), strict, True, True)
    assert "transform(array(" not in sql and "'item', " not in sql
    assert "__typename IN" not in sql and ".type IN" not in sql
