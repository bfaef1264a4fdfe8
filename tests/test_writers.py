"""Single files, media in parts, live stops."""

import json
import os
import random
import subprocess
import sys
import textwrap

import pytest
from pyspark.sql import functions as F

from marklake.operators.attempts import failure_streaks, open_failures
from marklake.operators.fetch import PART_BYTES, fetch_media, transfer
from marklake.sinks import files
from marklake.streaming import breaker

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


# --- One file for each conversation -----------------------------------------------------------------------------------


def names_below(path):
    """Files that readers see; tasks of a failed job may still write to its staging folder after it was deleted."""
    found = {str(p.relative_to(path)) for p in path.rglob("*") if p.is_file() and not p.name.endswith(".crc")}
    return {n for n in found if not n.startswith("_staged-")}


def test_conversation_files(spark, tmp_path):
    path = tmp_path / "out"
    ids = [str(i) for i in range(60)] + ["a/b", "c+d %é", "x_extracted"]
    docs = spark.createDataFrame([(i, n, None) for n, i in enumerate(ids)], "conv_id string, n long, empty string").repartition(5)
    files.write_conversation_files(docs, str(path))
    assert {os.path.basename(n) for n in names_below(path)} >= {"7_extracted.json", "a%2Fb_extracted.json"}
    assert len(names_below(path)) == len(ids) and all(n[2] == "/" for n in names_below(path))
    back = {r.conv_id: (r.part, json.loads(r.value)) for r in files.read_conversation_files(spark, str(path)).collect()}
    assert back == {i: (0, {"conv_id": i, "n": n, "empty": None}) for n, i in enumerate(ids)}
    # Written again, a file replaces its older self and the others stay; parts have files of their own.
    more = spark.createDataFrame([("7", 0, "new"), ("7", 2, "part"), ("new", 0, "x")], "conv_id string, part int, text string")
    files.write_conversation_files(more, "file:" + str(path))
    back = {(r.conv_id, r.part): json.loads(r.value) for r in files.read_conversation_files(spark, str(path)).collect()}
    assert len(back) == len(ids) + 2 and back["7", 0] == {"conv_id": "7", "text": "new"} and back["7", 2]["text"] == "part"
    files.write_conversation_files(more.limit(0), str(path))
    assert len(names_below(path)) == len(ids) + 2


def test_conversation_files_survive_lost_tasks_and_jobs(spark, tmp_path, monkeypatch):
    path = tmp_path / "out"
    docs = spark.range(0, 40, 1, 4).select(F.col("id").cast("string").alias("conv_id"))
    # A job that fails shows nothing.
    broken = docs.select(F.when(F.col("conv_id") == "33", F.raise_error(F.lit("no"))).otherwise(F.col("conv_id")).alias("conv_id"))
    with pytest.raises(Exception, match="no"):
        files.write_conversation_files(broken, str(path))
    assert names_below(path) == set()
    # An attempt that was lost before the commit isn't listed in it.
    lost = path / "_staged-x" / "dead" / "00"
    lost.mkdir(parents=True)
    (lost / "99_extracted.json").write_text("half")
    (path / "_staged-x" / "kept" / "01").mkdir(parents=True)
    (path / "_staged-x" / "kept" / "01" / "5_extracted.json").write_text("{}")
    assert names_below(path) == set()
    (path / "_staged-x" / "_committed").write_text("kept")
    # A job that died after its commit is completed by the next one, whose own moves are then lost, too.
    finish = files.finish_conversation_files
    calls = []
    monkeypatch.setattr(files, "finish_conversation_files", lambda *a: calls.append(1) or (finish(*a) if len(calls) == 1 else None))
    files.write_conversation_files(docs, str(path))
    assert {os.path.basename(n) for n in names_below(path)} == {"5_extracted.json"}
    for _ in range(2):
        finish(spark, str(path))
        assert len(names_below(path)) == 41 and files.read_conversation_files(spark, str(path)).count() == 41


# --- Media in parts ---------------------------------------------------------------------------------------------------


class Recorder:
    """A sink that keeps parts in memory and can be told to fail."""

    def __init__(self, fail_at=None):
        self.done, self.aborted, self.fail_at, self.parts = {}, [], fail_at, 0

    def begin(self, key, content_type=None):
        return {"key": key, "kind": content_type, "parts": []}

    def part(self, upload, number, data):
        self.parts += 1
        if self.parts == self.fail_at:
            raise OSError("lost")
        assert number == len(upload["parts"]) + 1
        upload["parts"].append(data)
        return number

    def complete(self, upload, receipts):
        assert receipts == list(range(1, len(upload["parts"]) + 1))
        self.done[upload["key"]] = upload["parts"]
        return "at/" + upload["key"]

    def abort(self, upload):
        self.aborted.append(upload["key"])


def test_transfer_in_parts():
    sink = Recorder()
    assert transfer((b"x" * 7 for _ in range(10)), sink, "k", "image/png", part_bytes=16) == "at/k"
    assert [len(p) for p in sink.done["k"]] == [16, 16, 16, 16, 6] and sink.aborted == []
    assert transfer([b"ab" * 16], sink, "one", part_bytes=32) and [len(p) for p in sink.done["one"]] == [32]
    for empty in ([], [b""], iter(())):
        with pytest.raises(OSError, match="empty"):
            transfer(empty, sink, "none")
    assert sink.aborted == ["none"] * 3 and "none" not in sink.done

    def breaks():
        yield b"x" * 40
        raise TimeoutError("gone")

    with pytest.raises(TimeoutError):
        transfer(breaks(), sink, "half", part_bytes=16)
    assert sink.aborted[-1] == "half" and "half" not in sink.done


def test_fetch_in_parts_retries_from_the_start(spark, tmp_path):
    root, tries = str(tmp_path / "media"), str(tmp_path / "tries")
    os.mkdir(tries)

    def fetcher(address):
        name = address.rsplit("/", 1)[-1]
        with open(f"{tries}/{name}", "a") as log:
            log.write("x")
        first = os.path.getsize(f"{tries}/{name}") == 1
        yield b"0123456789" * 3
        if name == "flaky" and first:
            raise OSError("cut")
        if name == "never":
            raise OSError("always")
        yield name.encode()

    def nothing(address):
        yield b""

    rows = [("1", n, f"https://m/{n}", f"1/{n}.bin", "image/png") for n in ("good", "flaky", "never")]
    manifest = spark.createDataFrame(rows, "tweet_id string, media_id string, media_url string, key string, content_type string")
    done = fetch_media(manifest, fetcher, files.FolderSink(root), max_retries=1, retry_delay=0.0, typed=True, part_bytes=8)
    found = {r.media_id: r for r in done.collect()}
    assert (found["good"].location, found["good"].attempts) == (f"{root}/1/good.bin", 1)
    assert (found["flaky"].location, found["flaky"].attempts) == (f"{root}/1/flaky.bin", 2)
    assert found["never"].location is None and found["never"].error == "OSError: always"
    left = sorted(os.path.join(d, f)[len(root) + 1 :] for d, _, names in os.walk(root) for f in names)
    assert left == ["1/flaky.bin", "1/good.bin"]
    assert open(f"{root}/1/flaky.bin").read() == "0123456789" * 3 + "flaky"
    empty = fetch_media(manifest.limit(1), nothing, files.FolderSink(root), max_retries=0).first()
    assert empty.error == "OSError: empty payload"
    # A sink for whole payloads takes chunks, too.
    whole = fetch_media(manifest.limit(1), fetcher, lambda key, data: f"{key}:{len(data)}", max_retries=0).first()
    assert whole.location == "1/good.bin:34"


def test_payload_larger_than_the_worker(tmp_path):
    """3 GB go through a process that may hold 1.5 GB."""
    script = f"""
        import resource, sys
        sys.path.insert(0, {ROOT!r})
        from marklake.operators.fetch import CHUNK_BYTES, PART_BYTES, transfer
        resource.setrlimit(resource.RLIMIT_AS, (3 << 29, 3 << 29))
        class Sink:
            total, largest = 0, 0
            def begin(self, key, kind): return key
            def part(self, upload, number, data):
                self.total += len(data); self.largest = max(self.largest, len(data)); return number
            def complete(self, upload, receipts): return len(receipts)
            def abort(self, upload): raise SystemExit("aborted")
        sink = Sink()
        n = (3 << 30) // CHUNK_BYTES
        parts = transfer((bytes(CHUNK_BYTES) for _ in range(n)), sink, "k")
        assert sink.total == 3 << 30 and sink.largest == PART_BYTES and parts == -(-(3 << 30) // PART_BYTES)
        print("done")
    """
    out = subprocess.run([sys.executable, "-c", textwrap.dedent(script)], capture_output=True, text=True, timeout=120)
    assert out.stdout.strip() == "done", out.stderr[-2000:]
    assert PART_BYTES == 5 << 20


# --- Live stops -------------------------------------------------------------------------------------------------------


def attempt_rows(seed=4):
    rnd = random.Random(seed)
    rows = []
    for source in ("a", "b", "c", "d", None):
        chance = {"a": 0.9, "b": 0.5, "c": 1.0, "d": 0.0}.get(source, 0.8)
        rows += [(source, seq, f"{source}{seq}", rnd.random() >= chance) for seq in sorted(rnd.sample(range(120), 60))]
    return rows


ATTEMPTS = "source string, seq long, tweet_id string, ok boolean"


def test_streaks_go_on_from_earlier_attempts(spark):
    rows = attempt_rows()
    whole = spark.createDataFrame(rows, ATTEMPTS)
    for cuts in ([40], [0, 50, 51], [119]):
        bounds = [-1, *cuts, 1000]
        found, before = set(), None
        for low, high in zip(bounds, bounds[1:]):
            part = whole.where(f"seq > {low} AND seq <= {high}")
            stretch = F.expr("seq div 9")
            found |= {r.tweet_id for r in failure_streaks(part, 4, stretch=stretch, before=before).collect()}
            now = {r.source: r.failures for r in open_failures(part, stretch=stretch, before=before).collect()}
            kept = {} if before is None else {r.source: r.failures for r in before.collect()}
            before = spark.createDataFrame(list({**kept, **now}.items()), "source string, failures long")
        assert found == {r.tweet_id for r in failure_streaks(whole, 4).collect()}
        for source in ("a", "b", "c", "d", None):
            tail = 0
            for s, _, _, ok in rows:
                if s == source:
                    tail = 0 if ok else tail + 1
            assert next(r.failures for r in before.collect() if r.source == source) == tail


def test_live_stops_equal_the_batch_operator(spark, tmp_path):
    incoming, state, checkpoint = tmp_path / "in", str(tmp_path / "state"), str(tmp_path / "checkpoint")
    incoming.mkdir()
    rows = attempt_rows(7)
    assert breaker.stops(spark, state) is None
    for n, (low, high) in enumerate(((0, 31), (31, 33), (33, 200))):
        lines = [json.dumps(dict(zip(("source", "seq", "tweet_id", "ok"), r))) for r in rows if low <= r[1] < high]
        (incoming / f"{n}.json").write_text("\n".join(lines))
        arriving = spark.readStream.schema(ATTEMPTS).json(str(incoming))
        breaker.watch_failures(arriving, state, checkpoint, n=6).awaitTermination()
        so_far = spark.createDataFrame([r for r in rows if r[1] < high], ATTEMPTS)
        want = {r.tweet_id for r in failure_streaks(so_far, 6).collect()}
        assert {r.tweet_id for r in breaker.stops(spark, state).collect()} == want
    # A batch that is replayed leads to the same stops.
    for name in ("2", ".2.crc"):
        if os.path.exists(f"{checkpoint}/commits/{name}"):
            os.remove(f"{checkpoint}/commits/{name}")
    breaker.watch_failures(spark.readStream.schema(ATTEMPTS).json(str(incoming)), state, checkpoint, n=6).awaitTermination()
    assert {r.tweet_id for r in breaker.stops(spark, state).collect()} == want
    work = spark.createDataFrame([("a", 1), ("d", 2), (None, 3)], "source string, x int")
    stopped = {r.source for r in breaker.stops(spark, state).collect()}
    assert {r.source for r in breaker.without_stopped(work, breaker.stops(spark, state)).collect()} == {"a", "d", None} - stopped
