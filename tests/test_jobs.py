"""Whole jobs: batch extraction, incremental ingest, stream."""

import json
import os
import shutil

import pytest

from marklake.operators.conversations import assemble_conversations, extract_conversations
from marklake.operators.posts import extract_posts
from marklake.operators.validate import validate_conversations
from marklake.plans.batch import extract_batch
from marklake.plans import batch, ingest
from marklake.plans.ingest import compact_state, late_captures, latest_documents, run_ingest, run_ledger
from marklake.plans.workflow import run_workflow, store_media_of
from marklake.sinks.files import FolderSink
from marklake.sinks.ledger import open_ledger
from marklake.sinks.raw import append_documents, compact_documents, current_documents
from marklake.sources.files import read_captures, read_conversations
from marklake.streaming.ingest import capture_stream, ingest_stream
from payloads import document, frame, main, media, post, reply, without

GOOD = document(main(post("1", "one", media_items=[media("m1")])), reply(post("2", "two")))
BAD = document(main({"__typename": "Strange"}))


def captures(spark, *rows):
    data = [(c, n, json.dumps({"data": d})) for c, n, d in rows]
    return spark.createDataFrame(data, "conv_id string, capture_no int, raw string")


def pages(spark, *ids):
    entries = [{"entryId": f"tweet-{i}"} for i in ids]
    raw = {"data": {"bookmark_timeline_v2": {"timeline": {"instructions": [{"entries": entries}]}}}}
    return spark.createDataFrame([(json.dumps(raw),)], "raw string")


def test_batch(spark, tmp_path):
    source = tmp_path / "in"
    (source / "deeper").mkdir(parents=True)
    for name, doc in (("100", GOOD), ("9007199254740993", GOOD), ("bad", BAD), ("no main", document(reply(post())))):
        (source / f"{name}.json").write_text(json.dumps(doc, indent=4))
    (source / "cut.json").write_text(json.dumps(GOOD)[:-20])
    (source / "deeper" / "5.json").write_text(json.dumps(GOOD))
    raw = read_conversations(spark, str(source))
    assert raw.count() == 5
    out = str(tmp_path / "out")
    first = extract_batch(spark, raw, out, "1")
    assert {r.conv_id for r in first.documents.collect()} == {"100", "9007199254740993"}
    assert {(r.conv_id, r.stage) for r in first.failures.collect()} == {
        ("bad", "validate"), ("no main", "extract"), ("cut", "validate")}
    assert tuple(first.summary.first()) == (2, 3)
    # Damage one output: it is done again, the other is skipped, failures are retried.
    target = tmp_path / "out" / "documents" / "run=1"
    for part in target.glob("part-*"):
        lines = [x if '"conv_id":"100"' not in x else x[:-5] for x in part.read_text().splitlines()]
        part.write_text("\n".join(lines))
        (target / f".{part.name}.crc").unlink(missing_ok=True)
    second = extract_batch(spark, raw, out, "2")
    assert {r.conv_id for r in second.documents.collect()} == {"100"}
    assert tuple(second.summary.first()) == (1, 3)
    with pytest.raises(ValueError):
        read_conversations(spark, str(source), "xml")


def test_ingest_retries_failures_only(spark, tmp_path):
    state = str(tmp_path / "state")
    saved = pages(spark, "a", "b", "c", "a")
    first = run_ingest(spark, saved, captures(spark, ("a", 0, GOOD), ("b", 0, BAD), ("x", 0, GOOD)), state, run_id="1")
    assert sorted(r.tweet_id for r in first.pending.collect()) == ["a", "b", "c"]
    assert [r.conv_id for r in first.documents.collect()] == ["a"]
    assert [(r.conv_id, r.stage) for r in first.failures.collect()] == [("b", "validate")]
    # The raw document of a failed conversation is kept, its id is not in the ledger.
    assert {r.conv_id for r in spark.read.parquet(f"{state}/raw").collect()} == {"a", "b"}
    assert [r.tweet_id for r in run_ledger(spark, state).collect()] == ["a"]
    assert [(r.tweet_id, r.key, r.location) for r in first.media.collect()] == [("1", "1/m1.jpg", "s3://media/1/m1.jpg")]

    # A capture of "a" is replaced by one that can't be used: its earlier document stays the latest one.
    second = run_ingest(spark, saved, captures(spark, ("a", 0, BAD), ("b", 0, GOOD)), state, run_id="2")
    assert [r.conv_id for r in second.documents.collect()] == ["b"]
    assert [(r.conv_id, r.stage) for r in second.failures.collect()] == [("a", "validate")]
    assert sorted(r.conv_id for r in latest_documents(spark, state).collect()) == ["a", "b"]
    assert sorted(r.tweet_id for r in run_ledger(spark, state).collect()) == ["a", "b"]
    assert [r.tweet_id for r in second.processed.collect()] == ["b"]

    # The same again changes nothing, whether under a new or under the old name.
    third = run_ingest(spark, saved, captures(spark, ("a", 0, BAD), ("b", 0, GOOD)), state, run_id="3")
    assert third.documents.count() == third.media.count() == 0
    run_ingest(spark, saved, captures(spark, ("b", 0, GOOD)), state, run_id="2")
    assert sorted(r.conv_id for r in latest_documents(spark, state).collect()) == ["a", "b"]
    assert sorted(r.tweet_id for r in run_ledger(spark, state).collect()) == ["a", "b"]


def test_ingest_uses_saved_pending_list(spark, tmp_path):
    state = str(tmp_path / "state")
    run_ingest(spark, pages(spark, "a", "b"), captures(spark), state, run_id="1")
    found = run_ingest(spark, pages(spark, "c"), captures(spark, ("a", 0, GOOD), ("c", 0, GOOD)), state, run_id="2",
                       use_existing_pending=True)
    assert [r.conv_id for r in found.documents.collect()] == ["a"]
    # Without a saved list it falls back to the pages.
    other = str(tmp_path / "other")
    found = run_ingest(spark, pages(spark, "c"), captures(spark, ("c", 0, GOOD)), other, run_id="1", use_existing_pending=True)
    assert [r.conv_id for r in found.documents.collect()] == ["c"]


def test_ingest_of_conversations_in_parts(spark, tmp_path):
    rows = [("a", n, document(main(post(str(n), f"main {n}")), reply(post(f"r{n}", f"reply {n}")))) for n in (0, 1, 130)]
    rows += [("b", 0, GOOD), ("b", 100, BAD), ("c", 0, document(reply(post()))), ("c", 100, document(main(post("5"))))]
    rows += [("d", 0, document(reply(post()))), ("e", 0, GOOD), ("f", 0, BAD)]
    found = run_ingest(spark, None, captures(spark, *rows), str(tmp_path / "s"), run_id="1")
    docs = {(r.conv_id, r.part): r for r in found.documents.collect()}
    # One bad part fails "b"; "d" has no main post; the last main post of "a" counts.
    assert set(docs) == {("a", 0), ("a", 2), ("c", 0), ("c", 1), ("e", 0)}
    assert docs["a", 0].main_tweet is None and docs["a", 2].main_tweet.text == "main 130"
    assert [r.text for r in docs["a", 0].replies] == ["reply 0", "reply 1"]
    assert docs["c", 0].main_tweet is None and docs["c", 1].main_tweet.id == "5"
    assert {(r.conv_id, r.reason) for r in found.failures.collect()} == {
        ("b", "invalid post"), ("d", "no main post"), ("f", "invalid post")}
    assert sorted(r.tweet_id for r in found.processed.collect()) == ["a", "c", "e"]
    assert latest_documents(spark, str(tmp_path / "s")).count() == 5


def test_stream(spark, tmp_path):
    incoming = tmp_path / "incoming"
    incoming.mkdir()

    def drop(name, *rows):
        lines = [json.dumps({"conv_id": c, "capture_no": n, "raw": json.dumps({"data": d})}) for c, n, d in rows]
        (incoming / name).write_text("\n".join(lines))

    state, checkpoint = str(tmp_path / "state"), str(tmp_path / "checkpoint")
    run = lambda: ingest_stream(capture_stream(spark, str(incoming)), state, checkpoint).awaitTermination()
    drop("1.json", ("a", 0, GOOD), ("b", 0, BAD))
    run()
    run()
    assert [r.conv_id for r in latest_documents(spark, state).collect()] == ["a"]
    drop("2.json", ("a", 0, GOOD), ("b", 0, GOOD))
    run()
    assert sorted(r.conv_id for r in latest_documents(spark, state).collect()) == ["a", "b"]
    assert read_captures(spark, str(incoming)).count() == 4
    # A batch replayed after a failure before its commit rewrites its own run.
    os.remove(f"{checkpoint}/commits/1")
    crc = f"{checkpoint}/commits/.1.crc"
    if os.path.exists(crc):
        os.remove(crc)
    run()
    assert sorted(r.conv_id for r in latest_documents(spark, state).collect()) == ["a", "b"]
    assert sorted(r.tweet_id for r in run_ledger(spark, state).collect()) == ["a", "b"]


def test_assembled_equals_in_row(spark):
    long = document(main(post("m", "first")), *[reply(post(f"r{i}", f"t{i}")) for i in range(25)], main(post("n", "last")))
    raw = frame(spark, a=GOOD, long=long, bad=BAD)
    posts = extract_posts(raw)
    documents, failed = assemble_conversations(posts, posts_per_document=10)
    rows = documents.orderBy("conv_id", "doc_no").collect()
    texts = [r.text for d in rows if d.conv_id == "long" for r in d.replies]
    direct = {r.conv_id: r for r in extract_conversations(raw).collect()}
    assert texts == [r.text for r in direct["long"].replies] == [f"t{i}" for i in range(25)]
    assert [d.main_tweet.text for d in rows if d.conv_id == "long" and d.main_tweet] == ["last"]
    assert direct["long"].main_tweet.text == "last" and set(direct) == {"a", "long"}
    assert failed.count() == 0
    _, failed = assemble_conversations(posts.where("role = 'reply'"))
    assert sorted((r.conv_id, r.stage) for r in failed.collect()) == [("a", "extract"), ("long", "extract")]


def test_violations(spark):
    wrapped = {"__typename": "TweetWithVisibilityResults", "tweet": without(post("1", typename=None), "legacy", "lang")}
    broken_media = post("1", typename=None, media_items=[without(media("m"), "sizes", "thumb", "h")])
    docs = {
        "good": GOOD,
        "tombstone": document(main(post("1")), reply(without(post("2"), "source"))),
        "wrapped": document(main(wrapped)),
        "media": document(main({"tweet": broken_media})),
        "kind": document(main({"__typename": "Strange"})),
        "entry": document(main(post("1")), without(reply(post("2")), "sortIndex")),
        "text": "nope",
    }
    good, bad = validate_conversations(frame(spark, **docs))
    assert {r.conv_id for r in good.collect()} == {"good", "tombstone"}
    paths = {r.conv_id: r.violations for r in bad.collect()}
    assert paths == {
        "wrapped": ["result.tweet.legacy.lang"],
        "media": ["result.tweet.legacy.entities.media[].sizes.thumb.h"],
        "kind": ["result"],
        "entry": ["instructions[].entries[].sortIndex"],
        "text": ["instructions"],
    }


def test_batch_repeated_under_its_own_run(spark, tmp_path):
    out = str(tmp_path / "out")
    raw = spark.createDataFrame([("a", json.dumps(GOOD))], "conv_id string, raw string")
    for _ in range(2):
        assert extract_batch(spark, raw, out, "1").documents.count() == 1
        assert spark.read.text(f"{out}/documents").count() == 1
    assert extract_batch(spark, raw, out, "2").documents.count() == 0


def test_batch_reads_no_old_text(spark, tmp_path, monkeypatch):
    out = str(tmp_path / "out")
    raw = spark.createDataFrame([(c, json.dumps(GOOD)) for c in ("a", "b+c d", "e")] + [("bad", "{}")], "conv_id string, raw string")
    extract_batch(spark, raw, out, "1")
    opened = []
    read = batch._lines
    monkeypatch.setattr(batch, "_lines", lambda *a: opened.append(sorted(r.file for r in a[2].collect())) or read(*a))
    done = batch.finished_ids(spark, out, "2")
    assert sorted(r.conv_id for r in done.collect()) == ["a", "b+c d", "e"] and opened == []
    plan = done._jdf.queryExecution().toString()
    assert "parquet" in plan and "FileScan text" not in plan and "FileScan json" not in plan
    second = extract_batch(spark, raw, out, "2")
    assert second.documents.count() == 0 and opened == []
    # The files of a run one of which changed are read, others aren't; their ids are noted once.
    path = next(p for p in (tmp_path / "out" / "documents" / "run=1").glob("part-*") if p.read_text())
    lost = {json.loads(x)["conv_id"] for x in path.read_text().splitlines()}
    path.write_text("damaged")
    (path.parent / f".{path.name}.crc").unlink(missing_ok=True)
    for _ in range(2):
        opened.clear()
        done = batch.finished_ids(spark, out, "3")
        assert {r.conv_id for r in done.collect()} == {"a", "b+c d", "e"} - lost
        assert opened == [] or [f.split("/")[0] for f in opened[0]] == ["run=1"] * len(opened[0])
    assert opened == []
    assert {r.conv_id for r in extract_batch(spark, raw, out, "3").documents.collect()} == lost
    # Without any manifest everything is read once.
    shutil.rmtree(f"{out}/manifest")
    assert {r.conv_id for r in batch.finished_ids(spark, out, "4").collect()} == {"a", "b+c d", "e"}


def test_two_streams_keep_apart(spark, tmp_path):
    state = str(tmp_path / "state")
    for name in "ab":
        incoming = tmp_path / f"incoming-{name}"
        incoming.mkdir()
        (incoming / "1.json").write_text(json.dumps({"conv_id": name, "capture_no": 0, "raw": json.dumps({"data": GOOD})}))
        ingest_stream(capture_stream(spark, str(incoming)), state, str(tmp_path / f"checkpoint-{name}")).awaitTermination()
    assert sorted(r.conv_id for r in latest_documents(spark, state).collect()) == ["a", "b"]


def replies_of(spark, state):
    return {(r.conv_id, r.run): [p.text for p in r.replies] for r in latest_documents(spark, state).collect()}


def answer(text):
    return document(reply(post(text, text)))


@pytest.mark.parametrize("with_pages", [False, True])
def test_late_captures_are_merged(spark, tmp_path, with_pages):
    state = str(tmp_path / "state")
    saved = pages(spark, "a", "b") if with_pages else None
    first = run_ingest(spark, saved, captures(spark, ("a", 0, GOOD)), state, run_id="1")
    assert first.late.count() == 0 and first.processed.count() == 1
    later = captures(spark, ("a", 1, answer("three")), ("b", 0, GOOD), (None, 0, GOOD), *([("x", 0, GOOD)] if with_pages else []))
    for _ in range(1 if with_pages else 2):
        second = run_ingest(spark, saved, later, state, run_id="2")
        assert sorted(r.conv_id for r in second.documents.collect()) == ["a", "b"]
        assert [r.tweet_id for r in second.processed.collect()] == ["b"]
        assert replies_of(spark, state) == {("a", "2"): ["two", "three"], ("b", "2"): ["two"]}
        found = {(r.conv_id, r.capture_no, r.reason, json.loads(r.raw) == {"data": GOOD}) for r in late_captures(spark, state).collect()}
        assert found == {(None, 0, "no id", True), *([("x", 0, "not saved", True)] if with_pages else [])}
    assert sorted(r.tweet_id for r in run_ledger(spark, state).collect()) == ["a", "b"]
    if with_pages:
        return
    # A capture that comes again under its number replaces the stored one; one that didn't change costs nothing.
    again = captures(spark, ("a", 1, answer("four")), ("b", 0, GOOD))
    third = run_ingest(spark, saved, again, state, run_id="3")
    assert [r.conv_id for r in third.documents.collect()] == ["a"]
    assert replies_of(spark, state) == {("a", "3"): ["two", "four"], ("b", "2"): ["two"]}
    # The earlier run, repeated now, doesn't bring the old version back.
    run_ingest(spark, saved, later, state, run_id="2")
    assert replies_of(spark, state)["a", "3"] == ["two", "four"]


def test_late_captures_after_compaction(spark, tmp_path):
    state = str(tmp_path / "state")
    run_ingest(spark, None, captures(spark, ("a", 0, GOOD), ("b", 0, BAD), (None, 0, GOOD)), state, run_id="1")
    run_ingest(spark, None, captures(spark, ("a", 1, answer("three")), ("c", 0, GOOD)), state, run_id="2")
    before = replies_of(spark, state)
    compact_state(spark, state)
    assert {k[0]: v for k, v in replies_of(spark, state).items()} == {k[0]: v for k, v in before.items()}
    # Only the bases are read from here on.
    for table in ("captures", "raw", "extracted"):
        for run in "12":
            shutil.rmtree(f"{state}/{table}/run={run}")
    # The failed conversation gets a main post, the others a reply; a run of the base counts as new when it is repeated.
    run_ingest(spark, None, captures(spark, ("a", 2, answer("four")), ("b", 0, GOOD)), state, run_id="2")
    found = {k[0]: v for k, v in replies_of(spark, state).items()}
    assert found == {"a": ["two", "three", "four"], "b": ["two"], "c": ["two"]}
    assert sorted(r.tweet_id for r in run_ledger(spark, state).collect()) == ["a", "b", "c"]
    fields = current_documents(spark, state, ("conv_id", "part")).collect()
    assert {r.conv_id for r in fields} == {"a", "b", "c"}
    entries = {r.conv_id: json.loads(r.raw)["threaded_conversation_with_injections_v2"]["instructions"][0]["entries"] for r in fields}
    assert [len(entries[c]) for c in "abc"] == [4, 2, 2]


def test_order_of_runs_does_not_depend_on_file_times(spark, tmp_path):
    state = str(tmp_path / "state")
    for run, text in (("z", "old"), ("a", "new")):
        run_ingest(spark, None, captures(spark, ("a", 0, GOOD), ("a", 1, answer(text))), state, run_id=run)
    for path in (tmp_path / "state").rglob("*"):
        os.utime(path, (2_000_000_000, 2_000_000_000) if "run=z" in str(path) else (1, 1))
    assert replies_of(spark, state) == {("a", "a"): ["two", "new"]}


def test_run_reads_captures_of_touched_buckets_only(spark, tmp_path):
    state = str(tmp_path / "state")
    run_ingest(spark, None, captures(spark, *[(f"c{i}", 0, GOOD) for i in range(40)]), state, run_id="1")
    history = ingest.read_runs(spark, state, "captures", schema=ingest.STORED_DDL)
    ids = spark.createDataFrame([("c7",)], "conv_id string")
    pruned = ingest._in_buckets_of(history, ids)
    plan = pruned._jdf.queryExecution().executedPlan().toString()
    filters = plan.split("PartitionFilters: ")[1].split("PushedFilters")[0]
    assert "bucket" in filters and 1 <= pruned.count() < 40


def test_ledger_is_not_moved_by_the_difference(spark, tmp_path):
    ledger = open_ledger(spark, str(tmp_path / "it's" / "ledger"), buckets=4)
    ids = lambda *x: spark.createDataFrame([(i,) for i in x], "tweet_id string")
    ledger.append(ids("a", "b", "a", None), "1")
    assert sorted(r.tweet_id for r in ledger.append(ids("b", "c"), "2").collect()) == ["c"]
    ledger = open_ledger(spark, str(tmp_path / "it's" / "ledger"), buckets=99)  # it keeps its own number
    assert ledger.buckets == 4 and sorted(r.tweet_id for r in ledger.rows("2").collect()) == ["a", "b"]
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        pending = ledger.pending(ids("a", "x", "x", None))
        assert [r.tweet_id for r in pending.collect()] == ["x"]
        plan = pending._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    final = plan.split("Initial Plan")[0]
    right = final[final.index("FileScan parquet"):]
    assert "Bucketed: true" in right and "SelectedBucketsCount: 4 out of 4" in right
    between = final[: final.index("FileScan parquet")].rsplit("Scan ExistingRDD", 1)[-1]
    assert "Exchange" not in between and "Shuffle" not in between


def test_raw_documents_are_merged_by_field(spark, tmp_path):
    state = str(tmp_path / "state")
    docs = lambda *rows: spark.createDataFrame(rows, "conv_id string, seq int, raw string")
    read = lambda: {r.conv_id: json.loads(r.raw) for r in current_documents(spark, state).collect()}
    with pytest.raises(ValueError):
        current_documents(spark, state)
    append_documents(spark, state, docs(("a", 1, '{"x":1,"y":"5","z":null}'), ("b", 1, "{}"), (None, 1, '{"x":0}'), ("t", 1, "no json")).drop("seq"), "1")
    assert read() == {"a": {"x": 1, "y": "5", "z": None}, "b": {}, None: {"x": 0}, "t": {}}
    update = docs(("a", 1, '{"x":{"q\\"":[1,"é"]}}'), ("a", 2, '{"w":true,"x":{"deep":[]}}'), ("c", 1, '{"b":1,"a":2}'))
    with pytest.raises(Exception, match="need an order"):
        append_documents(spark, state, update.drop("seq"), "2")
    merged = {"a": {"w": True, "x": {"deep": []}, "y": "5", "z": None}, "b": {}, None: {"x": 0}, "t": {}, "c": {"a": 2, "b": 1}}
    for _ in range(2):
        append_documents(spark, state, update, "2", order="seq")
        assert read() == merged
    assert compact_documents(spark, state) == 2
    shutil.rmtree(f"{state}/raw/run=1")
    shutil.rmtree(f"{state}/raw/run=2")
    assert read() == merged
    append_documents(spark, state, docs(("b", 1, '{"n":1}')).drop("seq"), "3")
    assert read() == {**merged, "b": {"n": 1}}
    with pytest.raises(ValueError):
        append_documents(spark, state, docs(("b", 1, "{}")).drop("seq"), "base-7")


def test_jobs_reject_what_the_model_rejects(spark, tmp_path):
    """A post with a number in a text field becomes a placeholder, unless the job is told to be lax."""
    number = post("1", "one")
    number["source"] = 5
    rows = captures(spark, ("a", 0, document(main(number))))
    texts = []
    for name, options in (("strict", {}), ("lax", {"strict": False})):
        found = run_ingest(spark, None, rows, str(tmp_path / name), run_id="1", **options).documents
        texts.append(found.first()["main_tweet"]["text"])
    assert texts == ["[Unknown tweet format]", "one"]


def test_jobs_check_the_session(spark, tmp_path):
    spark.conf.set("spark.sql.session.timeZone", "Asia/Tokyo")
    try:
        with pytest.raises(ValueError, match="timeZone"):
            run_ingest(spark, None, captures(spark, ("a", 0, GOOD)), str(tmp_path), run_id="1")
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_repeated_keys_need_an_order(spark):
    from marklake.sinks import tables

    target = spark.createDataFrame([(1, "x")], "id int, v string")
    updates = spark.createDataFrame([(1, "y"), (1, "z")], "id int, v string")
    with pytest.raises(Exception, match="need an order"):
        tables.upsert_documents(target, updates, "id").collect()
    assert [tuple(r) for r in tables.upsert_documents(target, updates.limit(1), "id").collect()] == [(1, "y")]


def test_workflow_from_ids_to_stored_media(spark, tmp_path):
    state, root = str(tmp_path / "state"), str(tmp_path / "media")
    sink = FolderSink(root)
    fetched = str(tmp_path / "fetched")

    def fetcher(address):
        with open(fetched, "a") as log:
            log.write(f"{address}\n")
        yield b"payload of "
        yield address.encode()

    run = lambda run_id: run_workflow(
        spark, pages(spark, "a"), captures(spark, ("a", 0, GOOD)), state, fetcher, sink, run_id=run_id, media_root=root
    )
    done = run("1")
    assert [r.conv_id for r in done.ingest.documents.collect()] == ["a"]
    (only,) = done.media.locations.collect()
    assert only.locations == [f"{root}/1/m1.jpg"] and open(only.locations[0]).read().startswith("payload of https://")
    # Again: the object is there, and its location is the manifest's.
    again = run("1")
    assert [r.locations for r in again.media.locations.collect()] == [["s3://media/1/m1.jpg"]]
    ids = spark.createDataFrame([("a",), ("zz",)], "tweet_id string")
    asked = store_media_of(spark, ids, state, fetcher, sink, run_id="x", media_root=root)
    assert [r.attempts for r in asked.results.collect()] == [0]
    fresh = store_media_of(spark, ids, state, fetcher, sink, run_id="y")
    assert [r.attempts for r in fresh.results.collect()] == [1]
    assert len(open(fetched).read().splitlines()) == 2


def test_batch_in_compressed_lines(spark, tmp_path):
    out = str(tmp_path / "out")
    raw = spark.createDataFrame([(c, json.dumps(GOOD)) for c in ("a", "b+c d")], "conv_id string, raw string")
    assert extract_batch(spark, raw, out, "1", compression="gzip").documents.count() == 2
    written = list((tmp_path / "out" / "documents" / "run=1").glob("part-*"))
    assert written and all(p.name.endswith(".json.gz") for p in written)
    assert {json.loads(r.value)["conv_id"] for r in spark.read.text(f"{out}/documents").collect()} == {"a", "b+c d"}
    shutil.rmtree(f"{out}/manifest")
    assert extract_batch(spark, raw, out, "2").documents.count() == 0


def test_late_captures_move_no_other_text(spark, tmp_path, monkeypatch):
    """Which captures are late is told by the ids that aren't asked for, few or many of them."""
    from marklake.functions import joins
    from marklake.plans.ingest import run_ingest

    page = {"data": {"bookmark_timeline_v2": {"timeline": {"instructions": [{"entries": [{"entryId": "tweet-a"}]}]}}}}
    pages = spark.createDataFrame([(json.dumps(page),)], "raw string")
    raw = json.dumps({"data": GOOD})
    captures = spark.createDataFrame([("a", 0, raw), ("b", 0, raw), ("b", 1, raw), (None, 0, raw)], "conv_id string, capture_no int, raw string")
    for most in (10, 0):
        monkeypatch.setattr(joins.as_lookup, "__defaults__", (most,))
        state = str(tmp_path / f"state{most}")
        done = run_ingest(spark, pages, captures, state, run_id="1")
        assert [r.conv_id for r in done.documents.collect()] == ["a"]
        late = sorted((r.conv_id or "", r.capture_no, r.reason) for r in done.late.collect())
        assert late == [("", 0, "no id"), ("b", 0, "not saved"), ("b", 1, "not saved")]
        assert sorted(r.r_id or "" for r in spark.read.parquet(f"{state}/refused").collect()) == ["", "b"]
