"""Saved ids, ledger, upserts, attempts, captures, bookmark trees, readers."""

import json
import random
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from marklake.operators import attempts, bookmark_tree, captures, ids
from marklake.plans.browser import browser_bookmarks
from marklake.sinks import tables
from marklake.sources import files
from payloads import document, main, post, reply


def page(*entries, instructions=True):
    body = [{"entries": [e if isinstance(e, dict) else {"entryId": e} for e in entries]}] if instructions else []
    return {"data": {"bookmark_timeline_v2": {"timeline": {"instructions": body}}}}


def test_saved_ids(spark, tmp_path):
    pages = [
        page("tweet-1", "cursor-top-5", "tweet-1", "tweet-9007199254740993"),
        page("tweet-2", {}, "tweet-3"),
        page("tweet-4", "tweet", "tweet-5"),
        page("promoted-tweet-9", "nothing"),
        page(instructions=False),
        {"other": 1},
        7,
    ]
    (tmp_path / "a.json").write_text(json.dumps(pages, indent=2))
    (tmp_path / "skip.txt").write_text("[]")
    read = files.read_bookmark_pages(spark, str(tmp_path))
    assert read.count() == 7
    found = ids.extract_saved_ids(read).orderBy("page_no", "entry_pos").collect()
    assert [r.tweet_id for r in found] == ["1", "1", "9007199254740993", "2", "4", "tweet"]


def test_id_list_and_ledger(spark, tmp_path):
    (tmp_path / "ids.json").write_text('["10", "9", "10", "2"]')
    listed = files.read_id_list(spark, str(tmp_path / "ids.json"))
    assert sorted(r.tweet_id for r in listed.collect()) == ["10", "2", "9"]
    assert sorted(r.tweet_id for r in files.read_id_list(spark, str(tmp_path / "ids.json"), True).collect()) == [2, 9, 10]
    assert [r.tweet_id for r in ids.ordered_ids(listed).collect()] == ["10", "2", "9"]

    (tmp_path / "bad.json").write_text('["10", ')
    with pytest.raises(Exception, match="[Mm]alformed"):
        files.read_id_list(spark, str(tmp_path / "bad.json")).collect()

    path = str(tmp_path / "ledger")
    assert files.read_ledger(spark, path).count() == 0
    now = datetime(2024, 1, 2, 3, 4, 5)
    first = spark.createDataFrame([("2",), ("2",), ("77",)], "tweet_id string")
    tables.append_ledger(spark, path, first, now)
    tables.append_ledger(spark, path, first, now)
    ledger = files.read_ledger(spark, path)
    assert sorted((r.tweet_id, r.created_at) for r in ledger.collect()) == [("2", now), ("77", now)]
    assert files.read_ledger(spark, path, "77").count() == 1
    with pytest.raises(ValueError):
        tables.append_ledger(spark, path, spark.createDataFrame([("2",), ("5",)], "tweet_id string"), on_conflict="error")
    with pytest.raises(ValueError):
        tables.append_ledger(spark, path, spark.createDataFrame([("5",), ("5",)], "tweet_id string"), on_conflict="error")
    assert files.read_ledger(spark, path).count() == 2

    assert sorted(r.tweet_id for r in ids.find_pending(listed, ledger).collect()) == ["10", "9"]
    stats = ids.pending_stats(listed, ledger).first()
    # The processed count is that of the whole ledger, saved or not.
    assert tuple(stats) == (3, 2, 2)
    empty = spark.createDataFrame([], "tweet_id string")
    assert tuple(ids.pending_stats(empty, empty).first()) == (0, 0, 0)


def test_skip_processed(spark):
    inputs = spark.createDataFrame([("a",), ("b",), ("c",)], "conv_id string")
    outputs = spark.createDataFrame([("a", "{}"), ("b", '{"x":')], "conv_id string, value string")
    assert sorted(r.conv_id for r in ids.skip_processed(inputs, outputs).collect()) == ["b", "c"]


def test_upserts(spark):
    target = spark.createDataFrame([("1", '{"a":1,"b":"x"}'), ("2", '{"a":2}')], "id string, raw string")
    updates = spark.createDataFrame(
        [("1", 2, '{"b":{"n":[1]},"c":null}'), ("1", 1, '{"b":"old","d":4}'), ("3", 1, '{"z":true}')],
        "id string, seq int, raw string",
    )
    doc = tables.parse_document(F.col("raw")).alias("doc")
    merged = tables.upsert_raw(target.select("id", doc), updates.select("id", "seq", doc), "id", order="seq")
    found = {r.id: json.loads(r.j) for r in merged.select("id", F.to_json("doc").alias("j")).collect()}
    assert found == {"1": {"a": 1, "b": {"n": [1]}, "c": None, "d": 4}, "2": {"a": 2}, "3": {"z": True}}

    rows = tables.upsert_documents(target, updates, "id", order="seq").collect()
    assert sorted((r.id, r.raw) for r in rows) == [("1", '{"b":{"n":[1]},"c":null}'), ("2", '{"a":2}'), ("3", '{"z":true}')]
    change = spark.createDataFrame([("1", '{"a":1,"b":"x"}'), ("2", "{}"), ("9", "{}")], "id string, raw string")
    assert tuple(tables.upsert_action_counts(target, change, "id").first()) == (1, 1, 1)


def test_upserts_of_empty_documents_and_ties(spark):
    doc = tables.parse_document(F.col("raw")).alias("doc")
    old = spark.createDataFrame([("1", '{"a":1}'), (None, '{"n":1}')], "id string, raw string").select("id", doc)
    rows = [("1", 1, "{}"), ("2", 1, "{}"), ("3", 1, "{}"), ("3", 2, '{"x":1}'), ("4", 1, '{"x":"a"}'), ("4", 1, '{"x":"b","y":1}'), ("5", None, '{"x":1}')]
    new = spark.createDataFrame(rows, "id string, seq int, raw string")
    for _ in range(2):
        merged = tables.upsert_raw(old, new.repartition(3).select("id", "seq", doc), "id", order="seq")
        found = {r.id: json.loads(r.j) for r in merged.select("id", F.to_json("doc").alias("j")).collect()}
        assert found == {"1": {"a": 1}, None: {"n": 1}, "2": {}, "3": {"x": 1}, "4": {"x": "b", "y": 1}, "5": {"x": 1}}
        whole = tables.upsert_documents(new.drop("seq").limit(0), new.repartition(3), "id", order="seq").collect()
        assert {r.id: r.raw for r in whole} == {"1": "{}", "2": "{}", "3": '{"x":1}', "4": '{"x":"b","y":1}', "5": '{"x":1}'}
    alone = spark.createDataFrame([(1, 5), (1, 7)], "id int, seq int")
    assert [tuple(r) for r in tables.upsert_documents(alone.select("id").limit(0), alone, "id", order="seq").collect()] == [(1,)]


def test_failure_streaks_of_null_sources(spark):
    rows = [(None, i, f"n{i}", False) for i in range(10)] + [("s", i, f"s{i}", False) for i in range(10)]
    df = spark.createDataFrame(rows, "source string, seq bigint, tweet_id string, ok boolean")
    for size in (3, 100):
        found = attempts.failure_streaks(df, n=5, stretch=F.expr(f"seq div {size}")).collect()
        assert sorted(r.tweet_id for r in found) == ["n4", "s4"]
    unplaced = spark.createDataFrame([("s", None, "u", False)] + rows[10:13], df.schema)
    assert [r.tweet_id for r in attempts.failure_streaks(unplaced, n=2).collect()] == ["s0"]


def test_snapshots(spark, tmp_path):
    df = spark.createDataFrame([("1",)], "tweet_id string")
    tables.write_snapshot(df, str(tmp_path / "ids"), "20240101_000000")
    tables.write_snapshot(df, str(tmp_path / "ids"), "20240102_000000")
    assert spark.read.json(str(tmp_path / "ids")).count() == 2
    tables.write_snapshot(df, str(tmp_path / "pending"))
    tables.write_snapshot(df, str(tmp_path / "pending"))
    assert spark.read.json(str(tmp_path / "pending")).count() == 1


@pytest.mark.parametrize("seed", [1, 2])
def test_failure_streaks_match_brute_force(spark, seed):
    rng = random.Random(seed)
    rows = []
    for source in "abcd":
        chance = {"a": 0.9, "b": 0.5, "c": 1.0, "d": 0.0}[source]
        rows += [(source, seq, f"{source}{seq}", rng.random() >= chance) for seq in sorted(rng.sample(range(400), 150))]
    df = spark.createDataFrame(rows, "source string, seq bigint, tweet_id string, ok boolean")
    for n in (1, 3, 12):
        want, run = set(), {}
        for source, seq, tweet_id, ok in rows:
            run[source] = 0 if ok else run.get(source, 0) + 1
            if run[source] == n:
                want.add(tweet_id)
        for size in (7, 40, 1000):
            found = attempts.failure_streaks(df, n=n, stretch=F.expr(f"seq div {size}")).collect()
            assert {r.tweet_id for r in found} == want and len(found) == len(want), (n, size)
    assert tuple(attempts.batch_summary(df).first()) == (sum(r[3] for r in rows), sum(not r[3] for r in rows))
    assert attempts.failed_ids(df).count() == sum(not r[3] for r in rows)


def test_merge_captures(spark):
    wrap = lambda d: json.dumps({"data": d})
    rows = [
        ("a", 1, wrap(document(reply(post("2")), reply(post("2"))))),
        ("a", 0, wrap(document(main(post("1")), before=[{"type": "TimelineClearCache"}]))),
        ("a", 70, wrap(document(reply(post("3"))))),
        ("b", 0, '{"errors":[]}'),
        ("b", 1, "oops"),
    ]
    df = spark.createDataFrame(rows, "conv_id string, capture_no int, raw string")
    merged = {(r.conv_id, r.part): json.loads(r.raw) for r in captures.merge_capture_pages(df).collect()}
    at = lambda d: [e["entryId"] for e in d["threaded_conversation_with_injections_v2"]["instructions"][0]["entries"]]
    assert at(merged["a", 0]) == ["tweet-1", "conversationthread-1", "conversationthread-1"]
    assert at(merged["a", 1]) == ["conversationthread-1"] and at(merged["b", 0]) == []
    assert merged["a", 0]["threaded_conversation_with_injections_v2"]["instructions"][0]["entries"][0] == main(post("1"))
    assert captures.capture_entries(df).count() == 4


def tree():
    leaf = lambda n: {"type": "url", "name": n, "url": f"https://{n}", "date_added": "13350000000000000"}
    folder = lambda n, *c: {"type": "folder", "name": n, "children": list(c)}
    deep = folder("d0", leaf("bottom"))
    for n in range(1, 30):
        deep = folder(f"d{n}", deep)
    return {"roots": {"bar": folder("Bar", leaf("one"), folder("In [x]", leaf("two"), {"type": "separator"}), deep, leaf("three")),
                      "other": leaf("root"), "synced": folder("Mobile")}}


def test_bookmark_tree(spark, tmp_path):
    profile = tmp_path / "Default"
    (tmp_path / "Snapshots" / "1").mkdir(parents=True)
    profile.mkdir()
    (profile / "Bookmarks").write_text(json.dumps(tree(), indent=3))
    (profile / "AccountBookmarks").write_text(json.dumps({"roots": {}}))
    (profile / "Other").write_text("{}")
    (tmp_path / "Snapshots" / "1" / "Bookmarks").write_text(json.dumps(tree()))
    for name, broken in (("P1", {"roots": {"bar": {"type": "folder", "name": "x"}}}), ("P2", {"roots": {"bar": {"name": "x"}}}),
                         ("P3", {"x": 1})):
        (tmp_path / name).mkdir()
        (tmp_path / name / "Bookmarks").write_text(json.dumps(broken))
    read = files.read_browser_bookmarks(spark, str(tmp_path), "Chrome")
    assert read.count() == 5
    good, failed = bookmark_tree.flatten_bookmark_tree(read)
    rows = good.orderBy("file", "path").collect()
    assert [(r.name, r.folder) for r in rows] == [("one", "Bar"), ("two", "In [x]"), ("bottom", "d0"), ("three", "Bar"), ("root", "other")]
    assert {str(r.date_added) for r in rows} == {"2024-01-17"} and len(rows[2].folder_path) == 31
    assert sorted(r.file.split("/")[-2] for r in failed.collect()) == ["P1", "P2", "P3"]
    assert [r.name for r in bookmark_tree.preview(good, 2).collect()] == ["one", "two"]
    assert browser_bookmarks(spark, str(tmp_path), "chrome")[0].count() == 5
    with pytest.raises(ValueError):
        browser_bookmarks(spark, str(tmp_path / "P2"), "edge")
    with pytest.raises(ValueError):
        files.read_browser_bookmarks(spark, str(tmp_path), "netscape")
    with pytest.raises(ValueError):
        files.read_browser_bookmarks(spark, str(tmp_path / "Snapshots"), "chrome")


def test_deep_tree_beside_flat_ones(spark):
    leaf = lambda n: {"type": "url", "name": n, "url": f"https://{n}", "date_added": "13350000000000000"}
    deep = {"type": "folder", "name": "d", "children": [leaf("bottom")]}
    for n in range(110):
        deep = {"type": "folder", "name": f"d{n}", "children": [deep, *([leaf(f"beside{n}")] if n % 100 == 0 else [])]}
    rows = [("deep", json.dumps({"roots": {"bar": deep}}))]
    rows += [(f"flat{i}", json.dumps({"roots": {"bar": {"type": "folder", "name": "b", "children": [leaf(f"f{i}")]}}})) for i in range(300)]
    files_ = spark.createDataFrame(rows, "file string, raw string").repartition(4)
    good, failed = bookmark_tree.flatten_bookmark_tree(files_, levels=10)
    found = good.collect()
    assert failed.count() == 0 and len(found) == 300 + 1 + 2
    bottom = next(r for r in found if r.name == "bottom")
    assert len(bottom.path) == 112 and bottom.folder == "d" and bottom.folder_path[0] == "d109"
    assert {r.name for r in found if r.file == "flat7"} == {"f7"}
    # The plan holds one round, not one generator for each level of the deepest file.
    assert good._jdf.queryExecution().logical().toString().count("Generate") == 0


def test_files_are_listed_and_read_by_tasks(spark, tmp_path):
    """As Spark's own index and reader give them, without an index of all files on the driver."""
    names = ["a b", "p%20q", "plus+x", "\u00e9 \u00fc", "q\"<>[]{}|^`#", "_hid", "_k=1", ".dot", "x._COPYING_", "colon;=@&,'()!$~*"]
    for n in names:
        (tmp_path / n / "deeper").mkdir(parents=True)
        (tmp_path / n / "Bookmarks").write_text(n)
        (tmp_path / n / "deeper" / f"{n}Bookmarks").write_bytes(b"\xff\xfe" + n.encode())
    (tmp_path / "emptyBookmarks").touch()
    root = str(tmp_path)
    plain = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    base = len(f"file:{root}/")
    listed = files.list_objects(spark, root)
    assert sorted(map(tuple, listed.collect())) == sorted((r.path[base:], r.length) for r in plain.select("path", "length").collect())
    assert "binaryFile" not in listed._jdf.queryExecution().toString()
    read = files.read_browser_bookmarks(spark, root, "chrome")
    want = spark.read.option("pathGlobFilter", "*Bookmarks").option("recursiveFileLookup", True).text(root, wholetext=True)
    want = want.select(F.col("_metadata.file_path").alias("file"), F.hex(F.col("value").cast("binary")))
    got = read.select("file", F.hex(F.col("raw").cast("binary")))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) and got.count() == 14
    assert "FileScan text" not in read._jdf.queryExecution().toString()
