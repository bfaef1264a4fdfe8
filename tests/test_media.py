"""Media listing, limits, keys, fetching, stored locations."""

import pytest
from pyspark.sql import functions as F

from marklake.functions.scalars import content_type, media_key, webkit_date, whole_seconds
from marklake.operators import media as ops
from marklake.operators.conversations import extract_conversations
from marklake.operators.fetch import fetch_media
from marklake.operators.posts import extract_posts
from marklake.sources.files import list_objects
from payloads import document, frame, main, media, post, reply, video


@pytest.fixture(scope="module")
def raw(spark):
    picture = {"key": "photo_image_full_size_original", "value": {"image_value": {"url": "https://card/1.png"}}}
    card = {"rest_id": "c", "legacy": {
        "binding_values": [picture], "card_platform": {"platform": {"audience": {}, "device": {}}},
        "name": "n", "url": "u", "user_refs_results": []}}
    quoted = post("9", "q", media_items=[media("q1")], card=card)
    article = {"article_results": {"result": {"rest_id": "a", "id": "a", "title": "T", "media_entities": [
        {"id": "i", "media_key": "k", "media_id": "am1",
         "media_info": {"__typename": "ApiImage", "original_img_url": "https://art/1.jpg"}},
        {"id": "i", "media_key": "k", "media_id": "am2",
         "media_info": {"__typename": "ApiVideo", "duration_millis": 31000,
                        "variants": [{"content_type": "v", "url": "https://art/v", "bitrate": 1}]}},
        {"id": "i", "media_key": "k", "media_id": "am3", "media_info": {"__typename": "ApiVideo"}},
        {"id": "i", "media_key": "k", "media_id": "am4", "media_info": {"__typename": "ApiImage"}},
    ]}}}
    items = [
        media("p1"),
        media("v1", "video", video=video(2500, ("https://v/a", None), ("https://v/b", 5), ("https://v/c", 5))),
        media("v2", "video", video=video(30501, ("https://v/long", 1))),
        media("g1", "animated_gif", video=video(None, ("https://g/a", None))),
        media("g2", "animated_gif"),
        media("v3", "video", video=video(1000)),
    ]
    whole = post("1", "t", media_items=items, card=card, article=article, quoted_status_result={"result": quoted})
    return frame(spark, a=document(main(whole), reply(post("2", "r", media_items=[media("r1")]))), b=document(main(post("3"))))


def listed(df):
    return [(r.tweet_id, r.media_id) for r in df.orderBy("conv_id", "pos", "media_pos").collect()]


def test_listing_order_and_limit(spark, raw):
    posts = extract_posts(raw)
    rows = ops.media_candidates(posts).orderBy("conv_id", "pos", "media_pos").collect()
    kinds = [(r.tweet_id, r.media_id if r.media_type != "card_image" else "card", r.media_type, r.media_duration) for r in rows]
    assert kinds == [
        ("1", "p1", "image", None), ("1", "v1", "video", 2), ("1", "g1", "animated_gif", 0),
        ("1", "card", "card_image", None), ("9", "q1", "image", None), ("1", "am1", "image", None),
        ("2", "r1", "image", None),
    ]
    by_id = {r.media_id: r for r in rows}
    assert by_id["p1"].media_url == "https://img/p1.jpg?name=orig"
    assert by_id["v1"].media_url == "https://v/b" and by_id["v1"].thumbnail_url is None
    assert len([r for r in rows if r.media_type == "card_image"][0].media_id) == 8


def test_flags(spark, raw):
    posts = extract_posts(raw)
    ids = lambda **f: {m for _, m in listed(ops.media_candidates(posts, **f))}
    assert {"v2", "am2"} <= ids(video_length_limit=None)
    assert not {"p1", "q1", "am1", "r1"} & ids(images=False)
    assert not {"v1", "g1"} & ids(videos=False)
    assert len(ids(card_images=False)) == len(ids()) - 1
    thumbs = ops.media_candidates(posts, thumbnails=True).where("media_id = 'v1'").first()
    assert thumbs.thumbnail_url == "https://img/v1.jpg?name=orig"


def test_documents_carry_their_media(spark, raw):
    docs = {r.conv_id: r for r in extract_conversations(raw, with_media=True).collect()}
    assert [m.media_id for m in docs["a"].main_tweet.extracted_media][:3] == ["p1", "v1", "v2"]
    assert [m.media_id for m in docs["a"].replies[0].extracted_media] == ["r1"]
    wanted = spark.createDataFrame([("a",), ("x",)], "tweet_id string")
    found = ops.media_for_ids(extract_conversations(raw, with_media=True), wanted)
    # With no length limit: four attached, card, quoted, three of the article, one of the reply.
    assert found.count() == 4 + 1 + 1 + 2 + 1


def test_keys(spark):
    rows = [
        ("m", "https://e.org/a/b.jpg?x=1.png", "1/m.jpg"), ("m", "https://e.org/a.b/c", "1/m"),
        ("m.x", "https://e.org/b.jpg", "1/m.x"), ("m", "https://e.org", "1/m"), ("m", "https://e.org/#a.b", "1/m"),
        ("m", "no scheme/x.tar.gz", "1/m.gz"), ("m", "", "1/m"), ("m", "https://e.org/x.", "1/m."),
    ]
    df = spark.createDataFrame(rows, "media_id string, url string, want string")
    found = df.select("want", media_key(F.lit("1"), F.col("media_id"), F.col("url")).alias("key")).collect()
    assert all(r.key == r.want for r in found)
    kinds = spark.createDataFrame([("a.JPG",), ("a.webp",), ("a.bin",), ("a",)], "key string")
    assert [r[0] for r in kinds.select(content_type(F.col("key"))).collect()] == ["image/jpeg", "image/webp", None, None]


def test_scalars(spark):
    df = spark.createDataFrame([(2500,), (3500,), (None,), (499,)], "m bigint")
    assert [r[0] for r in df.select(whole_seconds(F.col("m"))).collect()] == [2, 4, 0, 0]
    days = spark.createDataFrame([("13350000000000000",), ("0",), ("x",)], "t string")
    assert [str(r[0]) for r in days.select(webkit_date(F.col("t"))).collect()] == ["2024-01-17", "1601-01-01", "None"]


def test_fetch_retries_and_empty_payloads(spark, tmp_path):
    base = str(tmp_path)

    def fetcher(address):
        import pathlib

        marker = pathlib.Path(base, "tried-" + address)
        if address == "flaky" and not marker.exists():
            marker.touch()
            raise OSError("once")
        if address == "gone":
            raise OSError("never")
        return b"" if address == "empty" else b"data"

    def sink(key, data):
        import pathlib

        target = pathlib.Path(base, "store", key)
        target.parent.mkdir(parents=True, exist_ok=True)
        target.write_bytes(data)
        return "file://" + str(target)

    rows = [("1", n, i, n, f"1/{n}") for i, n in enumerate(("ok", "flaky", "gone", "empty"))]
    manifest = spark.createDataFrame(rows, "tweet_id string, media_id string, media_pos int, media_url string, key string")
    found = {r.media_id: r for r in fetch_media(manifest, fetcher, sink, max_retries=2, retry_delay=0.0).collect()}
    assert (found["ok"].attempts, found["flaky"].attempts) == (1, 2)
    assert found["gone"].location is None and found["gone"].attempts == 3 and "never" in found["gone"].error
    assert found["empty"].location is None and "empty" in found["empty"].error
    results = spark.createDataFrame([(r.tweet_id, r.media_pos, r.location) for r in found.values()],
                                    "tweet_id string, media_pos int, location string")
    stored = ops.stored_locations(results).collect()
    assert len(stored) == 1 and len(stored[0].locations) == 2
    # A second run skips what is stored; an empty object does not count.
    (tmp_path / "store" / "1" / "gone").touch()
    objects = list_objects(spark, f"{base}/store")
    assert {r.media_id for r in ops.skip_stored_media(manifest, objects).collect()} == {"gone", "empty"}


def test_long_location_lists_are_split(spark):
    results = spark.range(2500).select(
        F.when(F.col("id") < 2400, "hot").otherwise(F.concat(F.lit("t"), (F.col("id") % 10).cast("string"))).alias("tweet_id"),
        F.col("id").alias("media_pos"), F.col("id").cast("string").alias("location"))
    lists = ops.stored_locations(results, per_list=300).collect()
    hot = [r.locations for r in lists if r.tweet_id == "hot"]
    assert len(hot) == 8 and sorted(int(x) for ls in hot for x in ls) == list(range(2400))
    assert sorted([int(x) for x in ls] for ls in hot) == [list(range(a, a + 300)) for a in range(0, 2400, 300)]
    assert sorted(r.tweet_id for r in lists if r.tweet_id != "hot") == [f"t{i}" for i in range(10)]


def test_media_job(spark, tmp_path):
    """Stored objects aren't fetched again and stand in the locations; the sink learns the type."""
    from marklake.plans.media import run_media

    rows = [("1", f"m{i}", i, f"u{i}", f"1/m{i}.png", f"s3://b/1/m{i}.png", "image/png") for i in range(300)]
    manifest = spark.createDataFrame(rows, "tweet_id string, media_id string, media_pos int, media_url string, key string, "
                                           "location string, content_type string")
    objects = spark.createDataFrame([("1/m0.png", 5), ("1/m1.png", 0), ("1/m0.png", 5)], "key string, length bigint")

    def fetcher(address):
        if address == "u2":
            raise OSError("never")
        return b"x"

    def sink(key, data, kind):
        return f"{kind}:{key}"

    state = str(tmp_path)
    for _ in range(2):
        done = run_media(spark, manifest, objects, fetcher, sink, state, run_id="1", max_retries=0, typed=True)
        found = {r.media_pos: r for r in done.results.collect()}
        assert len(found) == 300 and (found[0].attempts, found[1].attempts, found[2].location) == (0, 1, None)
        assert [r.media_id for r in done.failures.collect()] == ["m2"]
        (only,) = done.locations.collect()
        assert only.locations[:2] == ["s3://b/1/m0.png", "image/png:1/m1.png"] and len(only.locations) == 299


def test_listed_documents_are_streamed_past_the_ids(spark, monkeypatch):
    """With few ids and with many: neither way sorts the texts, and repeated or null ids change nothing."""
    from marklake.functions import joins

    docs = spark.createDataFrame([(str(i), "x" * 9) for i in range(50)] + [(None, "n")], "conv_id string, raw string")
    ids = spark.createDataFrame([("3",), ("3",), ("7",), ("x",), (None,)], "tweet_id string")
    for most in (10, 2):
        monkeypatch.setattr(joins.as_lookup, "__defaults__", (most,))
        found = ops._listed(docs, ids)
        assert sorted(r.conv_id for r in found.collect()) == ["3", "7"]
        assert "SortMergeJoin" not in found._jdf.queryExecution().executedPlan().toString()


def test_fetches_wait_in_no_long_queue(spark):
    """A future for each connection: one for each row took longer than a fetch."""

    def waiting(url):
        import time
        from concurrent.futures import thread

        time.sleep(0.004)
        if url == "u7":
            raise OSError("gone")
        return str(max(queue.qsize() for queue in thread._threads_queues.values())).encode()

    rows = spark.range(300).select(F.lit("t").alias("tweet_id"), F.col("id").cast("string").alias("media_id"), F.concat(F.lit("u"), "id").alias("media_url"), F.col("id").cast("string").alias("key"))
    done = fetch_media(rows, waiting, lambda key, data: f"{key}:{data.decode()}", connections=4, partitions=1, max_retries=1, retry_delay=0.0).collect()
    assert sorted(int(r.media_id) for r in done) == list(range(300))
    assert {(r.media_id, r.attempts, r.location) for r in done if r.error} == {("7", 2, None)}
    kept = [r.location.split(":") for r in done if not r.error]
    assert all(key == r.media_id for (key, _), r in zip(kept, [r for r in done if not r.error])) and max(int(n) for _, n in kept) <= 4
