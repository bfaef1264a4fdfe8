"""Hand-written raw records for the tests."""

import json


def user(screen="ann", name="Ann"):
    legacy = {
        "default_profile": True, "default_profile_image": False, "description": "", "entities": {},
        "fast_followers_count": 0, "favourites_count": 1, "followers_count": 2, "friends_count": 3,
        "has_custom_timelines": False, "is_translator": False, "listed_count": 0, "media_count": 0,
        "normal_followers_count": 2, "pinned_tweet_ids_str": [],
    }
    return {
        "user_results": {
            "result": {
                "__typename": "User", "id": "VQ", "rest_id": "1",
                "core": {"created_at": "x", "name": name, "screen_name": screen}, "legacy": legacy,
            }
        }
    }


def url(short, expanded, start, end):
    return {"url": short, "expanded_url": expanded, "display_url": expanded, "indices": [start, end]}


def media(id_str="m1", kind="photo", expanded="https://x.com/p/1", start=0, end=0, video=None):
    size = {"h": 1, "w": 1, "resize": "fit"}
    out = {
        "id_str": id_str, "media_key": "3_" + id_str, "type": kind, "url": "https://t.co/m",
        "expanded_url": expanded, "display_url": "d", "media_url_https": f"https://img/{id_str}.jpg",
        "indices": [start, end], "ext_media_availability": {"status": "Available"},
        "sizes": {k: size for k in ("large", "medium", "small", "thumb")},
        "original_info": {"height": 1, "width": 1, "focus_rects": []},
    }
    if video is not None:
        out["video_info"] = video
    return out


def video(millis, *variants):
    return {
        "aspect_ratio": [16, 9], "duration_millis": millis,
        "variants": [{"content_type": "video/mp4", "url": u, "bitrate": b} for u, b in variants],
    }


def post(rest_id="1", text="hello", typename="Tweet", screen="ann", name="Ann", urls=(), mentions=(),
         hashtags=(), media_items=None, permalink=None, **extra):
    entities = {
        "urls": list(urls), "hashtags": list(hashtags), "symbols": [],
        "user_mentions": [{"id_str": "1", "name": m, "screen_name": m, "indices": [0, 0]} for m in mentions],
    }
    if media_items is not None:
        entities["media"] = media_items
    legacy = {
        "created_at": "Wed Oct 10 20:19:24 +0000 2018", "conversation_id_str": rest_id,
        "display_text_range": [0, len(text)], "entities": entities, "favorite_count": 1, "favorited": False,
        "full_text": text, "is_quote_status": False, "lang": "en", "quote_count": 0, "reply_count": 2,
        "retweet_count": 3, "retweeted": False,
    }
    if permalink:
        legacy["quoted_status_permalink"] = {"url": "u", "expanded": permalink, "display": "d"}
    out = {
        "rest_id": rest_id, "has_birdwatch_notes": False, "core": user(screen, name), "unmention_data": {},
        "edit_control": {}, "is_translatable": True, "views": {}, "source": "web", "legacy": legacy, **extra,
    }
    if typename is not None:
        out = {"__typename": typename, **out}
    return out


def note(text, urls=()):
    entity_set = {"urls": list(urls), "hashtags": [], "symbols": [], "user_mentions": []}
    return {"note_tweet_results": {"result": {"id": "n", "text": text, "entity_set": entity_set}}}


def without(record, *path):
    """Deep copy of a record without the field at ``path``."""
    copy = json.loads(json.dumps(record))
    at = copy
    for key in path[:-1]:
        at = at[key]
    del at[path[-1]]
    return copy


def item(result="absent", kind="TimelineTweet", display="Tweet", results="given"):
    out = {"itemType": kind, "__typename": kind}
    if display:
        out["tweetDisplayType"] = display
    if results == "given":
        out["tweet_results"] = {} if result == "absent" else {"result": result}
    return out


def cursor():
    return item(kind="TimelineTimelineCursor", display=None, results="none")


def entry(entry_id, item_content=None, items=None):
    content = {"entryType": "TimelineTimelineItem", "__typename": "TimelineTimelineItem"}
    if item_content is not None:
        content["itemContent"] = item_content
    if items is not None:
        content["items"] = [
            {"entryId": "i", "item": {"itemContent": i, "clientEventInfo": {}}} for i in items
        ]
    return {"entryId": entry_id, "sortIndex": "1", "content": content}


def main(result, entry_id="tweet-1"):
    return entry(entry_id, item(result))


def reply(result="absent", entry_id="conversationthread-1"):
    return entry(entry_id, items=[item(result)])


def document(*entries, before=()):
    instructions = [*before, {"type": "TimelineAddEntries", "entries": list(entries)}]
    return {"threaded_conversation_with_injections_v2": {"instructions": instructions}}


def frame(spark, **documents):
    """``conv_id, raw`` rows from keyword arguments; text values are taken as they are."""
    rows = [(k, v if isinstance(v, str) else json.dumps(v, ensure_ascii=False)) for k, v in documents.items()]
    return spark.createDataFrame(rows, "conv_id string, raw string")
