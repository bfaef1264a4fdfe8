"""Periodic runs, language identification and the prefix trie against brute force."""

import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from marklake.llm import chat, langid, periodic, prefixtrie, queries, tokens

SMALL = "/root/testdata/sf0.001"


def crc(i):
    return zlib.crc32(str(i).encode())


def words(text):
    return (text or "").encode().split()


# --- Periodic runs ----------------------------------------------------------------------------------------------------


def brute_runs(w):
    """Every maximal stretch of smallest period q and at least max(6, 4 * q) words, by looking at all lags."""
    out, n = [], len(w)
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and w[j] == w[j + q]:
                j += 1
            length = j + q - i
            if length >= max(6, 4 * q):
                stretch = w[i : i + q]
                smallest = all(q % d or stretch != stretch[:d] * (q // d) for d in range(1, q))
                if smallest:
                    out.append((i, length, q))
            i = max(j, i + 1)
    return sorted((s, p, length) for s, length, p in out)


def brute_kept(w, runs):
    gone = {i for s, p, length in runs for i in range(s + p, s + length)}
    return b" ".join(x for i, x in enumerate(w) if i not in gone).decode()


def periodic_texts():
    rnd = random.Random(3)
    out = [None, "", " \n", "a", "a " * 5, "a " * 6, "a b " * 4, "a b " * 3 + "a", "x " + "a b c " * 4 + "a b", "é " * 9, "a\x0bb " * 8]
    for _ in range(150):
        letters = rnd.choice(["ab", "abc", "abcdefgh"])
        n = rnd.choice([5, 20, 60, 200])
        w = [rnd.choice(letters) for _ in range(n)]
        for _ in range(rnd.randrange(3)):
            unit = [rnd.choice(letters) for _ in range(rnd.choice([1, 2, 3, 5, 8, 13, 21]))]
            at = rnd.randrange(len(w) + 1)
            w[at:at] = (unit * 8)[: rnd.randrange(3 * len(unit), 8 * len(unit))]
        out.append(rnd.choice(["", " "]) + rnd.choice([" ", "\n", " \t"]).join(w) + rnd.choice(["", " "]))
    nested = ("a " * 9 + "b ") * 6
    out += [nested, nested * 5, "w " * 30_000, " ".join(f"u{i % 5000}" for i in range(25_000))]
    return out


def test_runs_equal_brute_force(spark):
    texts = periodic_texts()
    docs = spark.createDataFrame([(i, t, "x", "y") for i, t in enumerate(texts)] + [(None, "a " * 7, "x", "y"), (0, None, "x", "y")], "doc_id long, text string, runs string, key string")
    got = periodic.periodic_runs(docs.repartition(3)).collect()
    assert len(got) == len(texts) + 2
    found = {r.doc_id: r for r in got}
    for i, t in enumerate(texts):
        w, r = words(t), found[i]
        if len(w) > 4000:
            continue
        runs = brute_runs(w)
        assert [(x.start, x.period, x.length) for x in r.runs] == runs, t
        assert (r.n_words, r.kept_text) == (len(w), brute_kept(w, runs))
    n = len(texts)
    assert [tuple(x) for x in found[n - 2].runs] == [(0, 30_000, 1)] and found[n - 2].kept_text == "w"
    assert [tuple(x) for x in found[n - 1].runs] == [(0, 25_000, 5000)] and len(words(found[n - 1].kept_text)) == 5000
    assert [tuple(x) for x in found[None].runs] == [(0, 7, 1)]
    assert periodic.periodic_runs(docs.where("false")).count() == 0


def planted(i, text):
    w, h = words(text), crc(i)
    g = h // 10
    if h % 10 or not w:
        return w
    a = g % len(w)
    p = 1 + (len(w) - a) // (3 + g % 8)
    return [w[j if j < a else a + (j - a) % p] for j in range(len(w))]


def test_op11_equals_brute_force(spark, tmp_path):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect() if len(words(r.text)) < 1500]
    rows += [(10_000 + i, t) for i, t in enumerate(periodic_texts()[:60])] + [(20_000 + i, " ".join(f"v{j}" for j in range(i % 97))) for i in range(200)]
    spark.createDataFrame(rows, "doc_id long, text string").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in queries.QUERIES["op11_periodic_runs"](spark, str(tmp_path)).collect()}
    assert len(got) == len(rows)
    for i, text in rows:
        w, r = planted(i, text), got[i]
        runs = brute_runs(w)
        lines = "".join(f"{s},{length},{p}\n" for s, p, length in runs)
        best = min(((-length, s, p) for s, p, length in runs), default=None)
        assert r.n_runs == len(runs)
        assert (r.start, r.length, r.period) == ((best[1], -best[0], best[2]) if best else (None, None, None))
        assert r.exponent_milli == (1000 * -best[0] // best[2] if best else None)
        assert r.runs_sha256 == hashlib.sha256(lines.encode()).hexdigest()
        assert r.collapsed_sha256 == hashlib.sha256(brute_kept(w, runs).encode()).hexdigest()


# --- Language identification ------------------------------------------------------------------------------------------


def test_op12_held_out_accuracy(spark):
    path = "/root/testdata/sf0.01"
    truth = {r.doc_id: r for r in spark.read.parquet(f"{path}/documents.parquet").collect()}
    got = queries.QUERIES["op12_language_id"](spark, path).collect()
    assert len(got) == len(truth)
    held = [r for r in got if r.held_out]
    assert {r.doc_id for r in held} == {i for i in truth if crc(i) % 5 == 0}
    assert sum(r.lang_pred == truth[r.doc_id].lang for r in held) >= 0.97 * len(held)
    sure = [r for r in held if r.accepted]
    assert sum(r.lang_pred == truth[r.doc_id].lang for r in sure) >= 0.985 * len(sure) and len(sure) > 0.9 * len(held)
    assert all(0 <= r.score <= 1 for r in got)
    again = queries.QUERIES["op12_language_id"](spark, path).collect()
    assert sorted(again) == sorted(got)


def test_languages_on_odd_rows(spark):
    schema = "doc_id long, text string, lang string, lead string, accepted string, label string"
    rnd = random.Random(1)
    known = {letters: ["".join(rnd.choice(letters) for _ in range(rnd.randrange(3, 9))) for _ in range(150)] for letters in ("abcde", "vwxyz")}
    text = lambda letters, n: " ".join(rnd.choice(known[letters]) for _ in range(n))
    rows = [(i, text("abcde" if i % 2 else "vwxyz", 80), "one" if i % 2 else "two", "", "", "") for i in range(60)]
    odd = [(100, None), (101, ""), (102, "123 !? \n"), (103, text("vwxyz", 30_000)), (104, "É"), (None, text("abcde", 40).upper()), (105, rows[0][1]), (105, rows[0][1])]
    train = spark.createDataFrame([*rows, (90, "no label", None, "", "", ""), (91, "99", "none", "", "", "")], schema)
    learned = langid.fit(train)
    assert learned.names == ("one", "two") and learned.rows == (30, 30)
    docs = spark.createDataFrame([(i, t, None, "a", "b", "c") for i, t in odd], schema)
    got = defaultdict(list)
    for r in langid.identify(docs, learned).collect():
        got[r.doc_id].append(r)
    for i in (100, 101, 102):
        assert tuple(got[i][0])[1:] == ("und", 0.0, 0.0, False)
    assert got[103][0].lang_pred == "two" and got[103][0].accepted
    assert got[104][0].lang_pred == "one" and not got[104][0].accepted and got[104][0].score == pytest.approx(0.5)
    assert got[None][0].lang_pred == "one" and len(got[105]) == 2
    assert langid.identify(docs.where("false"), learned).count() == 0
    nothing = langid.fit(train.where("false"))
    assert {(r.lang_pred, r.score) for r in langid.identify(docs, nothing).collect()} == {("und", 0.0)}


def test_hot_language_is_a_bounded_sample(spark):
    train = spark.range(3000).selectExpr("concat('hot word', cast(id as string), ' and more') as text", "if(id % 100 = 0, 'b', 'a') as lang")
    learned = langid.fit(train)
    assert learned.rows == (2970, 30) and all(len(c) <= langid.PIECES * (langid.STRETCH + 2) for c in learned.contents)


# --- Prefix trie ------------------------------------------------------------------------------------------------------


def brute_trie(rows, borrowed=True):
    convs = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            convs[c].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [t[2:] for t in sorted(v)] for c, v in convs.items()}
    rebuilt = {}
    for c, turns in own.items():
        h = crc(c) % 9 if borrowed else 0
        rebuilt[c] = (own.get(c - c % 5, [])[:h] if h else []) + turns[h:]
    members = defaultdict(list)
    for c, turns in rebuilt.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    out = set()
    for path, who in members.items():
        subtree = [p for p in members if p[: len(path)] == path]
        leaves = [p for p in subtree if not any(len(x) == len(p) + 1 and x[: len(p)] == p for x in subtree)]
        saved = sum((len(members[p]) - 1) * len(p[-1][1].encode()) for p in subtree if p)
        ends = ",".join(map(str, sorted(c for c in who if len(rebuilt[c]) == len(path))))
        parent = min(members[path[:-1]]) if path else None
        children = sum(len(p) == len(path) + 1 for p in subtree)
        out.add((min(who), len(path), parent, len(who), children, len(leaves), saved, hashlib.sha256(ends.encode()).hexdigest()))
    return out


CONVERSATIONS = "conv_id long, turn long, role string, text string, depth string, digest string, owner string"


def conversation_rows(n=60):
    rnd = random.Random(9)
    rows = [(None, 0, "user", "lost"), (7, None, None, None), (7, 0, "user", ""), (7, 3, "user", "né"), (7, 3, "user", "né")]
    for c in range(10, 10 + n):
        if c % 13 == 0:
            continue
        for turn in range(rnd.choice([1, 2, 4, 12])):
            text = "same" if turn < 3 and c % 3 else rnd.choice(["x", "yy", "ü" * 40])
            rows.append((c, turn, "user" if turn % 2 == 0 else "assistant", text))
    rows += [(500, t, "user", str(t)) for t in range(300)] + [(501, t, "user", str(t)) for t in range(300)]
    rows += [(c, t, "user", "hot") for c in range(1000, 1040) for t in range(2)]
    return rows


@pytest.mark.parametrize("borrowed", [True, False])
@pytest.mark.parametrize("shard_rows", [prefixtrie.SHARD_ROWS, 50])
def test_trie_equals_brute_force(spark, monkeypatch, borrowed, shard_rows):
    monkeypatch.setattr(prefixtrie, "SHARD_ROWS", shard_rows)
    rows = conversation_rows()
    turns = spark.createDataFrame([(*r, "", "", "") for r in rows], CONVERSATIONS).repartition(3)
    got = queries.trie_of(turns) if borrowed else prefixtrie.prefix_trie(turns)
    got = [tuple(r) for r in got.collect()]
    want = brute_trie(rows, borrowed)
    assert len(got) == len(set(got)) and set(got) == want


def test_trie_without_conversations(spark):
    turns = spark.createDataFrame([(None, 0, "user", "x", "", "", "")], CONVERSATIONS)
    assert prefixtrie.prefix_trie(turns).count() == 0
    assert prefixtrie.prefix_trie(turns.where("false")).count() == 0


def test_node_table_is_minimal_and_checked():
    rnd = np.random.default_rng(2)
    digests = rnd.integers(0, 1 << 63, size=(5000, 2), dtype=np.uint64)
    table = prefixtrie.NodeTable(digests)
    assert sorted(table.slots(digests).tolist()) == list(range(5000))
    with pytest.raises(ValueError):
        table.slots(rnd.integers(0, 1 << 63, size=(100, 2), dtype=np.uint64))
    assert len(prefixtrie.NodeTable(digests[:0]).held) == 0


# --- Chat formatting at any length ------------------------------------------------------------------------------------


@pytest.mark.parametrize("n", [1, 64, 70, 200])
def test_prefixes_are_those_of_the_whole_conversation(spark, n):
    def once(turns):
        return "<BOS>" + "".join(f"[{r}]{t}." for r, t in turns)

    def forgets_after(k):
        return lambda turns: once(turns[-k:])

    data = [(c, t, "assistant" if t % 2 else "user", f"text {c} {t}") for c in (1, 2) for t in range(n)]
    turns = spark.createDataFrame(data, "conv_id long, turn long, role string, text string").repartition(3)
    held = {c: [(r, x) for i, _, r, x in data if i == c] for c in (1, 2)}
    for template in (once, forgets_after(64), forgets_after(149), chat.instruction_template):
        got = {r.conv_id: r for r in chat.format_conversations(turns, template).collect()}
        assert len(got) == 2
        for c, mine in held.items():
            r = got[c]
            outputs = [template(mine[:k]) for k in range(n + 1)]
            rewrites = next((k for k in range(n) if not outputs[k + 1].startswith(outputs[k])), -1)
            assert (r.n_turns, r.formatted, r.rewritten) == (n, outputs[n], rewrites)
            if rewrites >= 0:
                assert set(r.span_start) | set(r.span_end) | set(r.text_start) == {-1}
                continue
            assert list(zip(r.span_start, r.span_end)) == [(len(a), len(b)) for a, b in zip(outputs, outputs[1:])]
            texts = [r.formatted[a:b] if a >= 0 else None for a, b in zip(r.text_start, r.text_end)]
            assert texts == [t if role == "assistant" else None for role, t in mine]
    assert forgets_after(64)(held[1]) == once(held[1][-64:])
    short = chat.format_conversations(turns, once, most_rendered=50).collect()
    assert all((r.formatted is None and r.rewritten is None and r.n_turns == n) == (n > 1) for r in short)
    assert {r.turns_sha256 is None for r in chat.read_back(chat.format_conversations(turns, most_rendered=50)).collect()} == {n > 1}


def test_op3_formats_every_conversation(spark):
    rows = spark.read.parquet(f"{SMALL}/conversations.parquet").collect()
    convs = defaultdict(list)
    for r in rows:
        convs[r.conv_id].append((r.turn, r.role or "", r.text or ""))
    text = "</s>[INST] ok [/INST]"
    convs[-1] = [(0, "user", text), (1, "assistant", text)]
    got = {r.conv_id: r for r in queries.QUERIES["op3_chat_formatting"](spark, SMALL).collect()}
    assert set(got) == set(convs)
    for c, turns in convs.items():
        turns.sort()
        loss = "".join(t for _, r, t in turns if r == "assistant")
        whole = "".join(f"{r}\n{t}\n" for _, r, t in turns)
        assert got[c].turns_sha256 == hashlib.sha256(whole.encode()).hexdigest() and got[c].n_turns == len(turns)
        assert (got[c].loss_chars, got[c].loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())


# --- Token counts at every prefix -------------------------------------------------------------------------------------


def test_prefix_counts_to_the_character(spark):
    import public_tokenizers
    import sentencepiece
    from pyspark.sql import functions as F

    from marklake.llm import tokens

    path = public_tokenizers.path("piece_bpe_32k.model")
    plain = sentencepiece.SentencePieceProcessor(model_file=path)
    count = lambda t: len(plain.encode(t))
    rnd = random.Random(8)
    texts = [None, "", " ", "  ", "a", " a", "ab ", "日本語の文章です。" * 60, "x" * 500, "internationalization", "▁a ▁", "é\x00😀b" * 5, "Hausboote und  Kähne\n\tim Hafen "]
    texts += ["".join(rnd.choice(["a", "the", " ", "  ", "ing", "日", "é", "😀", "\n", "▁", "Z"]) for _ in range(40)) for _ in range(25)]
    docs = spark.createDataFrame([(i, t, 5) for i, t in enumerate(texts)], "doc_id long, text string, prefixes int")
    held = tokens.with_prefix_counts(docs.repartition(3), path).cache()
    budgets, places = (0, 1, 7, 50, 10_000), (0, 1, 2, 5, 17, 39, 100, 499, 100_000)
    shown = held.select(
        "doc_id", tokens.total_of(F.col("prefixes")).alias("total"),
        F.array(*[tokens.within_budget(F.col("prefixes"), b) for b in budgets]).alias("cut"),
        F.array(*[tokens.tokens_at(F.col("prefixes"), F.lit(p)) for p in places]).alias("at"),
    ).collect()
    steps = {r.doc_id: list(r.prefixes.steps) for r in held.collect()}
    for r in shown:
        text = texts[r.doc_id] or ""
        counts = [count(text[:k]) for k in range(len(text) + 1)]
        assert [sum(steps[r.doc_id][:k]) for k in range(len(text) + 1)] == counts, text
        assert r.total == counts[-1] and list(r.at) == [counts[min(p, len(text))] for p in places]
        assert list(r.cut) == [max(k for k, c in enumerate(counts) if c <= b) for b in budgets], text
    assert tokens.with_prefix_counts(docs.where("false"), path).count() == 0


def test_a_model_that_normalises_is_refused(monkeypatch):
    import public_tokenizers
    import sentencepiece

    from marklake.llm import tokens

    class Folding(sentencepiece.SentencePieceProcessor):
        def normalize(self, text, **options):
            return super().normalize(text, **options).replace("Ａ", "A")

    monkeypatch.setattr(sentencepiece, "SentencePieceProcessor", Folding)
    with pytest.raises(ValueError, match="changes texts"):
        tokens.PieceCounter(public_tokenizers.path("piece_bpe_32k.model"))


def test_op10_counts_what_the_library_counts(spark):
    import public_tokenizers
    import sentencepiece

    plain = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    got = queries.QUERIES["op10_token_counts"](spark, SMALL).collect()
    assert len(got) == len(texts)
    for r in got:
        n = len(plain.encode(texts[r.doc_id]))
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(texts[r.doc_id].encode()), n, n > 4096)


# --- Foreign archives -------------------------------------------------------------------------------------------------


def record(kind, block, content_type, **headers):
    lines = ["WARC/1.0", f"WARC-Type: {kind}", f"Content-Type: {content_type}", *[f"{k.replace('_', '-')}: {v}" for k, v in headers.items()]]
    return "\r\n".join([*lines, f"Content-Length: {len(block)}"]).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def test_foreign_archives_keep_what_the_server_said(spark, tmp_path):
    import gzip

    from marklake.llm import warc

    picture = bytes(range(256)) * 2 + b"\r\n\r\n"
    head = b"HTTP/1.1 404 Not Found\r\nContent-Type: image/png\r\nX-Odd: \xff\r\nContent-Length: 516"
    answer = head + b"\r\n\r\n" + picture
    info = b"software: x\r\n\r\nsecond: part\r\n" + b"y" * 200
    http = "application/http;msgtype=response"
    one = record("warcinfo", info, "application/warc-fields", WARC_Record_ID="<i:1>") + record("warcinfo", info, "application/warc-fields", WARC_Record_ID="<i:2>")
    one += record("response", answer, http, WARC_Record_ID="<r:1>", WARC_Date="2020-01-01T00:00:00Z", X_Record_Key="2", WARC_Payload_Digest="sha1:ABCDEF")
    two = record("response", answer, http, WARC_Record_ID="<r:2>", X_Record_Key="1", WARC_Payload_Digest="sha1:OTHER")
    two += record("response", head + b"\r\n\r\n" + b"z" * 516, http, WARC_Record_ID="<r:3>", X_Record_Key="3", WARC_Payload_Digest="sha1:ABCDEF")
    two += record("revisit", head, http, WARC_Record_ID="<r:4>", X_Record_Key="4", WARC_Payload_Digest="sha1:FAR", WARC_Refers_To="<far>")
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.warc.gz").write_bytes(gzip.compress(one))
    (tmp_path / "in" / "b.warc").write_bytes(two)
    assert warc.read_archives(spark, str(tmp_path / "in")).count() == 6
    warc.deduplicate_archives(spark, str(tmp_path / "in"), str(tmp_path / "out"))
    got = {r.record_id: r for r in warc.read_archives(spark, str(tmp_path / "out")).collect()}
    assert set(got) == {"<i:1>", "<i:2>", "<r:1>", "<r:2>", "<r:3>", "<r:4>"}
    # The digests that the archives stated don't count: equal payloads are one, different ones aren't.
    assert (got["<r:2>"].record_type, bytes(got["<r:2>"].payload), bytes(got["<r:2>"].http)) == ("response", picture, head)
    assert (got["<r:1>"].record_type, got["<r:1>"].refers_to, got["<r:1>"].payload_bytes) == ("revisit", "<r:2>", 516)
    assert bytes(got["<r:1>"].http) == head and got["<r:1>"].payload_digest == hashlib.sha256(picture).hexdigest()
    assert got["<r:3>"].record_type == "response" and bytes(got["<r:3>"].payload) == b"z" * 516
    assert (got["<r:4>"].refers_to, got["<r:4>"].payload_digest) == ("<far>", "sha1:FAR")
    for i in ("<i:1>", "<i:2>"):
        assert (got[i].record_type, bytes(got[i].payload), got[i].http, got[i].content_type) == ("warcinfo", info, None, "application/warc-fields")


def test_long_conversations_are_rendered_whole(spark):
    """Beyond any amount of renderings: turn by turn where the template says so, as a black box where it doesn't."""
    odd = ["", "[INST] x [/INST]", "a\\\\", chat.MARK, "</s>"]
    held = [(("user", "assistant", "system", "tool")[i % 4], odd[i % 5] + str(i)) for i in range(60)]
    assert chat.render_by_turn(held, chat.instruction_template.turn) == chat.render(held, chat.instruction_template)
    # Some 7,000 turns add up to more renderings than were made at all before.
    n, text = 7000, "y" * 120
    rows = spark.range(n).select(F.lit(1).alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") % 2 == 0, "user").otherwise("assistant").alias("role"), F.lit(text).alias("text"))
    (r,) = chat.read_back(chat.format_conversations(rows)).collect()
    assert (r.n_turns, r.loss_chars, r.rewritten) == (n, n // 2 * len(text), False)
    assert r.loss_sha256 == hashlib.sha256((text * (n // 2)).encode()).hexdigest()


def test_every_prefix_is_rendered_at_any_length(spark, monkeypatch):
    """What a template says of its turns replaces no rendering; stretches of prefixes give what whole conversations give."""

    def drops(turns):
        return "".join(f"{r}:{t};" for r, t in turns[-150:])

    drops.turn = lambda role, text: f"{role}:{text};"

    def ends(turns):
        return "^" + "".join(f"<{r} {t}>" for r, t in turns) + ("$" if len(turns) == 31 else "")

    # Renderings of 200 turns of 600 characters come to 24 million characters, beyond where they were left out before.
    long = [(7, t, "assistant" if t % 2 else "user", f"{t} " + "z" * 600) for t in range(200)]
    (r,) = chat.format_conversations(spark.createDataFrame(long, "conv_id long, turn long, role string, text string"), drops).collect()
    held = [(role, text) for _, _, role, text in long]
    assert (r.rewritten, r.formatted, set(r.span_start)) == (150, drops(held), {-1}) and chat.render(held, drops)[2] == 150

    data = [(c, t // 2, ("user", "assistant", None)[t % 3], None if t == 5 else f"{t} {c}" * (t % 7)) for c in (1, 2, None) for t in range(40 if c != 2 else 3)]
    rows = spark.createDataFrame(data, "conv_id int, turn long, role string, text string").repartition(3)
    monkeypatch.setattr(chat, "SPREAD", 3000)
    monkeypatch.setattr(chat, "LEAST_PASSES", 2)
    for template in (ends, drops, chat.instruction_template):
        found = chat.format_conversations(rows, template)
        assert found.schema["conv_id"].dataType.typeName() == "integer"
        got = {r.conv_id: r for r in found.collect()}
        assert len(got) == 3
        for c, r in got.items():
            mine = sorted((t, role or "", text or "") for i, t, role, text in data if i == c)
            text, spans, rewritten = chat.render([x[1:] for x in mine], template)
            masks = [s[2:] if x[1] == "assistant" else (-1, -1) for x, s in zip(mine, spans)]
            assert (r.n_turns, r.formatted, r.rewritten) == (len(mine), text, rewritten)
            assert list(zip(r.span_start, r.span_end)) == [s[:2] for s in spans] and list(zip(r.text_start, r.text_end)) == masks
    assert got[1].rewritten == -1 and {r.rewritten for r in chat.format_conversations(rows, ends).collect()} == {31, -1}


def test_prefix_counts_try_few_starts():
    """Pieces are looked up by their endings; counts are the library's at every prefix that ends a text."""
    import public_tokenizers
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    counter, model = tokens.counter(path), sentencepiece.SentencePieceProcessor(model_file=path)
    assert set(map(len, counter.reached)) > {3, 4} and all(len(p) in counter._lengths[p[-3:]] for p in counter.reached if len(p) > 2)
    for text in ("internationalisation", "a\u00e9\U0001f600\u4e2d\x00b", "tokenstokens##--", "zzzzzzzzzzzz", "it's 12345,678"):
        for end in range(1, len(text) + 1):
            assert counter.total(text[:end]) == len(model.encode(text[:end]))
