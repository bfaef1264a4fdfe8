"""The operators against brute force on small tables with nulls, empty texts, ties, repeats and clashing names."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from marklake.llm import chat, mixing, orderminhash, packing, quality, sharding, substring, tokens, topk, warc

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, class_id string, slot string, tie string"


def make_rows(n=120):
    rnd = random.Random(5)
    words = ["w%d" % i for i in range(400)] + ["né", "<|endoftext|>", "#x", "a\x0bb", "日本"]
    text = lambda k: "".join(rnd.choice(words) + rnd.choice([" ", " ", "\n", "  "]) for _ in range(k))
    passage = text(60)
    rows = []
    for i in range(n):
        body = text(rnd.choice([3, 30, 90, 300]))
        if i % 5 == 0:
            body += passage + text(20)
        if i % 7 == 0 and i:
            body = rows[i - 3][1]
        if i % 11 == 0 and rows and rows[-1][1]:
            w = rows[-1][1].split(" ")
            w[len(w) // 2] = "edited"
            body = " ".join(w)
        rows.append((i, body))
    rows += [(n, None), (n + 1, ""), (n + 2, " \n\t"), (n + 3, "one two"), (n + 4, "rep eat " * 400), (n + 5, text(6000))]
    rows += [rows[1], (None, "no id " + passage)]
    return [(i, t, "en", None if k % 9 == 0 else f"src{k % 4}", len(t or ""), "x", "y", "z") for k, (i, t) in enumerate(rows)]


@pytest.fixture(scope="module")
def rows():
    return make_rows()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def words(text):
    return (text or "").encode().split()


def test_quality(docs, none, rows):
    got = {(r.doc_id, r.text): r for r in quality.judge_documents(docs, carry=("text",)).collect()}
    for i, t, *_ in rows:
        w, r = words(t), got[i, t]
        at = defaultdict(list)
        for p in range(len(w) - 7):
            at[tuple(w[p : p + 8])].append(p)
        repeated = {q for ps in at.values() if len(ps) > 1 for p in ps for q in range(p, p + 8)}
        lines = [x for x in (t or "").split("\n") if words(x)]
        assert (r.n_words, r.n_repeat_words, r.n_dup_lines) == (len(w), len(repeated), len(lines) - len(set(lines)))
        assert r.word_chars == sum(len(x.decode()) for x in w)
        assert r.base_failed == (len(w) < 20 or 100 * len(repeated) > 30 * len(w))
    assert quality.judge_documents(none).count() == 0


def test_frequent_lines_are_lost(spark):
    data = [(i, f"common line of all\nown {i} " + " ".join(f"w{i}x{j}" for j in range(25)), "h") for i in range(12)]
    data += [(20, "common line of all\n" + "short " * 3, "h")]
    found = {r.doc_id: r for r in quality.judge_documents(spark.createDataFrame(data, "doc_id long, text string, source string")).collect()}
    assert all(found[i].n_lost == 4 and found[i].kept for i in range(12)) and not found[20].kept


def test_substring(docs, none, rows):
    seen, want = set(), {}
    unique = {(i, t or "") for i, t, *_ in rows}
    for i, t in sorted(unique, key=lambda x: (x[0] is not None, x[0] or 0)):
        w = words(t)
        gone = [False] * len(w)
        for p in range(len(w) - 19):
            key = tuple(w[p : p + 20])
            if key in seen:
                gone[p : p + 20] = [True] * 20
            seen.add(key)
        want[i] = (len(w), sum(gone), b" ".join(x for x, g in zip(w, gone, strict=True) if not g).decode())
    got = substring.remove_repeats(docs).collect()
    assert len(got) == len(rows)
    for r in got:
        assert (r.n_words, r.n_removed, r.kept_text) == want[r.doc], r.doc
        assert sum(r.span_length) == r.n_removed
    assert sum(x[1] for x in want.values()) > 500
    assert substring.remove_repeats(none).count() == 0


def test_near_duplicates(spark, docs, none, rows):
    kmers = {}
    for i, t, *_ in rows:
        w = words(t)
        kmers[t or ""] = [tuple(w[p : p + 5]) for p in range(len(w) - 4)] or ([tuple(w)] if w else [])

    def common(x, y):
        row = [0] * (len(y) + 1)
        for a in x:
            new = [0]
            for j, b in enumerate(y):
                new.append(row[j] + 1 if a == b else max(row[j + 1], new[j]))
            row = new
        return row[-1]

    ids = {i: t or "" for i, t, *_ in rows if i is not None}
    parent = {i: i for i in ids}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a in ids:
        for b in ids:
            x, y = kmers[ids[a]], kmers[ids[b]]
            if a < b and root(a) != root(b) and (x == y and ids[a] == ids[b] or x and y and len(set(x) & set(y)) > 0.5 * max(len(x), len(y))):
                c = len(x) if x == y else common(x, y)
                if ids[a] == ids[b] or c / (len(x) + len(y) - c) >= 0.8:
                    p, q = sorted((root(a), root(b)))
                    parent[q] = p
    got = orderminhash.near_duplicates(docs).collect()
    assert len(got) == len(rows)
    assert {(r.doc_id, r.class_id) for r in got} == {(i, root(i)) for i in ids} | {(None, None)}
    kept = [r.doc_id for r in orderminhash.first_of_group(docs).collect()]
    assert Counter(kept) == Counter({root(i) for i in ids} | {None})
    assert orderminhash.first_of_group(none).count() == 0


def test_alignment():
    rnd = np.random.default_rng(1)
    for _ in range(300):
        x = rnd.integers(0, 60, rnd.integers(0, 80)).astype(np.uint64)
        y = x.copy()
        for _ in range(rnd.integers(0, 6)):
            if len(y):
                y = np.delete(y, rnd.integers(0, len(y)))
        table = [[0] * (len(y) + 1) for _ in range(len(x) + 1)]
        for i, a in enumerate(x):
            for j, b in enumerate(y):
                table[i + 1][j + 1] = table[i][j] + 1 if a == b else max(table[i][j + 1], table[i + 1][j])
        n = table[-1][-1]
        exact = n / (len(x) + len(y) - n) if len(x) and len(y) else float(len(x) == len(y))
        got = orderminhash.similarity(x, y)
        assert got == pytest.approx(exact) if exact >= 0.8 else got < 0.8


def test_packing(docs, none, rows):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    plain = Tokenizer.from_file(path)
    want = Counter()
    for i, t, *_ in rows:
        ids = plain.encode(t or "", add_special_tokens=False).ids + [2]
        first = len(ids) % 64 or min(64, len(ids))
        edges = [0, *range(first, len(ids) + 1, 64)]
        for k, (a, b) in enumerate(zip(edges, edges[1:], strict=False)):
            want[i, k, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())] += 1
    packed = packing.pack(packing.cut_documents(docs, path, capacity=64, with_ids=True), capacity=64)
    got = packed.collect()
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    held = defaultdict(list)
    for r in got:
        held[r.sequence_id].append((r.offset, r.length))
    for parts in held.values():
        assert [o for o, _ in sorted(parts)] == [sum(n for _, n in sorted(parts)[:k]) for k in range(len(parts))]
        assert sum(n for _, n in parts) <= 64
    assert len(held) <= 1.02 * sum(r.length for r in got) / 64 + 2
    assert packing.sequences(packed).agg(F.sum(F.octet_length("ids"))).first()[0] == 4 * sum(r.length for r in got)
    assert packing.pack(packing.cut_documents(none, path)).count() == 0


def test_tokens(docs, none, rows):
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    plain = sentencepiece.SentencePieceProcessor(model_file=path)
    count = lambda t: len(plain.encode(t or ""))
    got = tokens.with_prefix_counts(tokens.with_token_counts(docs, path), path).withColumn("cut", tokens.within_budget(F.col("prefixes"), 50)).collect()
    for r in got:
        assert r.n_tokens == count(r.text) and (r.prefixes.tokens or [0])[-1] == r.n_tokens
        assert count((r.text or "")[: r.cut]) <= 50
    assert tokens.with_token_counts(none, path).count() == 0
    held = tokens.counter(path)
    for text in ("", " ", "  a ", "▁x", "日本語 é\n\n\tb", "<s> </s>", "\x00a", "a" * 200):
        assert held.total(text) == count(text)
    assert held.profile("▁Hausboote") == [0, *[count("Hausboote"[:k]) or 1 for k in range(10)]]


def test_sharding(docs, none):
    text = F.coalesce("text", F.lit(""))
    sized = docs.select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), "slot", "lang")
    sized = sized.union(sized.where("doc_id = 3").withColumn("n", F.explode(F.sequence(F.lit(1), F.lit(200)))).drop("n"))
    got = sharding.shard_by_bytes(sized, "doc_id", "size", shards=4).collect()
    assert len(got) == sized.count()
    slots, sizes = defaultdict(list), Counter()
    for r in got:
        slots[r.shard].append(r.slot)
        sizes[r.shard] += r.size
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and set(slots) <= {0, 1, 2, 3}
    biggest = max(r.size for r in got)
    assert max(sizes.values()) - min(sizes.values()) <= biggest
    assert sharding.shard_by_bytes(none.select("doc_id", F.col("n_chars").alias("size")), "doc_id", "size").count() == 0


def test_mixing(docs, none, rows):
    got = mixing.mix(docs).collect()
    assert len(got) == len(rows)
    total, taken, target = Counter(), Counter(), {}
    for r in got:
        total[r.source] += r["size"]
        taken[r.source] += r.taken
        target[r.source] = r.target
        assert r.taken <= 3 * r["size"]
    weights = {s: (1, 2, 3)[k % 3] for k, s in enumerate(sorted(total, key=lambda s: (s is None, s or "")))}
    want, left, free = dict.fromkeys(total, 0.0), float(sum(total.values())), set(total)
    while left > 1e-6:
        share, over = sum(weights[s] for s in free), 0.0
        for s in list(free):
            want[s] += left * weights[s] / share
            if want[s] > 3 * total[s]:
                over += want[s] - 3 * total[s]
                want[s] = 3.0 * total[s]
                free.discard(s)
        left = over
    assert target == pytest.approx(want)
    for s in total:
        assert abs(taken[s] - want[s]) <= 0.05 * want[s] + 5
    assert sorted(map(tuple, got), key=repr) == sorted(map(tuple, mixing.mix(docs).collect()), key=repr)
    assert mixing.mix(none).count() == 0


def test_chat(spark):
    rnd = random.Random(3)
    parts = ["<s>", "</s>", "[INST]", "[/INST]", "[ROLE]", "\\", "<", "[", " ", "a", "/s>", "\n", None]
    data = [(c, t, rnd.choice(["user", "assistant", "system", "tool", None]), rnd.choice(parts) and "".join(x or "" for x in rnd.choices(parts, k=4))) for c in (1, 2, None) for t in range(150 if c == 2 else 5)]
    got = {r.conv_id: r for r in chat.read_back(chat.format_conversations(spark.createDataFrame(data, "conv_id long, turn long, role string, text string"))).collect()}
    for c in (1, 2, None):
        turns = [(r or "", t or "") for i, _, r, t in data if i == c]
        loss = "".join(t for r, t in turns if r == "assistant")
        assert got[c].turns_sha256 == hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest()
        assert (got[c].n_turns, got[c].loss_chars, got[c].loss_sha256) == (len(turns), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    forgetful = lambda turns: "".join(t for _, t in turns[-2:])
    assert chat.render([("user", "x"), ("assistant", "y"), ("user", "z")], forgetful)[2] == 2


def test_warc(spark):
    body, other = "é" * 80 + "\r\n\r\nWARC/1.1\r\n", "q" * 200
    data = [(3, "http://a", body, "k"), (2, "http://b\r\nX: y", body, "k"), (2, None, body, "k"), (9, "c", other, "k"), (4, "d", "tiny", "k"), (5, "d", "tiny", "k"), (6, "e", None, "k"), (None, "f", other, "k")]
    pages = spark.createDataFrame(data, "page_id long, url string, html string, record_id string")
    got = sorted(((r.key, r.payload_bytes, r.record_type, r.original_key) for r in warc.archive_pages(pages).collect() if r.key), key=repr)
    n = len(body.encode())
    assert got == [("2", n, "response", None), ("2", n, "revisit", "2"), ("3", n, "revisit", "2"), ("4", 4, "response", None), ("5", 4, "response", None), ("6", 0, "response", None), ("9", 200, "response", None)]
    assert warc.archive_pages(pages.limit(0)).count() == 0


def test_top_k(spark):
    rnd = np.random.default_rng(2)
    data = [(i, [float(x) for x in rnd.normal(size=6)]) for i in range(150)]
    data += [(200 + i, data[0][1]) for i in range(20)] + [(300, None), (301, [1.0, None]), (302, [float("nan")] * 6), (None, [1.0] * 6), data[5]]
    vectors = spark.createDataFrame([(*x, 1) for x in data], "vec_id long, embedding array<float>, score int")
    got = {(r.query_id, r.rank): (r.vec_id, r.score) for r in topk.top_k(vectors, F.col("vec_id") % 50 == 0).collect()}
    codes = {i: np.floor(256 * np.array(v, dtype=np.float32).astype(float)).astype(int) for i, v in data if i is not None and i < 300}
    for q in (i for i in codes if i % 50 == 0):
        best = sorted((-int(codes[q] @ c), i) for i, c in codes.items() if i != q)[:5]
        assert [got[q, k + 1] for k in range(5)] == [(i, -s) for s, i in best]
    assert topk.top_k(vectors.limit(0), F.col("vec_id") % 50 == 0).count() == 0


def test_pipeline_of_nothing(spark, none):
    held = none
    for name, stage in corpus_pipeline.STAGES:
        held = spark.createDataFrame([], stage(spark, held, "").schema)
        if name != "sequence_packing":
            assert tuple(held.columns) == corpus_pipeline.COLUMNS


def passing_lines(rows):
    """What the quality rules keep, line by line."""
    normal = lambda x: b" ".join(words(x)).decode().lower()
    lines = lambda t: [x for x in (t or "").split("\n") if words(x)]
    holders, texts = defaultdict(set), defaultdict(set)
    for _, t, _, source, *_ in rows:
        if lines(t):
            texts[source].add(t)
        for x in lines(t):
            holders[source, normal(x)].add(t)
    often = {k for k, v in holders.items() if len(v) > 10 and len(v) > 0.02 * len(texts[k[0]])}
    for i, t, lang, source, n_chars, *_ in rows:
        w = words(t)
        at = defaultdict(list)
        for p in range(len(w) - 7):
            at[tuple(w[p : p + 8])].append(p)
        repeated = {q for ps in at.values() if len(ps) > 1 for p in ps for q in range(p, p + 8)}
        lost = [x for x in lines(t) if (source, normal(x)) in often]
        gone = sum(len(words(x)) for x in lost)
        if len(w) < 20 or 100 * len(repeated) > 30 * len(w) or gone > 0.5 * len(w) or len(w) - gone < 20:
            continue
        left = "\n".join(x for x in t.split("\n") if x not in lost) if lost else t
        yield i, left, lang, source, len(left) if lost else n_chars


def test_pipeline(spark, docs, rows):
    """Each stage against brute force on what the one before it kept."""
    from tokenizers import Tokenizer

    stages = dict(corpus_pipeline.STAGES)
    shown = lambda df: Counter(map(tuple, df.collect()))

    def after(name, held):
        out = stages[name](spark, held, "")
        assert name == "sequence_packing" or tuple(out.columns) == corpus_pipeline.COLUMNS
        return spark.createDataFrame(out.collect(), out.schema)

    common = [(1000 + i, f"Read  more Here\n{'uvw'[i % 3]}{i} " + " ".join(f"p{i}q{j}" for j in range(40)), "en", "src1", 0, "", "", "") for i in range(15)]
    start = docs.union(spark.createDataFrame(common, docs.schema))
    first = after("quality_rules", start)
    assert shown(first) == Counter(passing_lines([*rows, *common])) and not any("Read" in r.text for r in first.collect())

    second = after("near_duplicates", first)
    classes = {(r.doc_id, r.class_id) for r in orderminhash.near_duplicates(first).collect()}
    assert Counter(r.doc_id for r in second.collect()) == Counter({c for _, c in classes if c is not None}) + Counter(r.doc_id for r in first.collect() if r.doc_id is None)
    assert not shown(second) - shown(first) and 0 < second.count() < first.count()

    third = after("substring_dedup", second)
    seen, want = set(), Counter()
    for r in sorted(second.collect(), key=lambda r: (r.doc_id is not None, r.doc_id or 0)):
        w = words(r.text)
        gone = [False] * len(w)
        for p in range(len(w) - 19):
            if (key := tuple(w[p : p + 20])) in seen:
                gone[p : p + 20] = [True] * 20
            seen.add(key)
        left = b" ".join(x for x, g in zip(w, gone, strict=True) if not g).decode() if any(gone) else r.text
        want[r.doc_id, left, r.lang, r.source, len(left) if any(gone) else r.n_chars] += 1
    assert shown(third) == want and shown(third) != shown(second)

    fourth = after("source_mixing", third)
    copies = Counter()
    for r in mixing.mix(third).collect():
        copies[r.doc_id, r.source] += r.copies
    assert Counter((r.doc_id, r.source) for r in fourth.collect()) == +copies and set(shown(fourth)) <= set(shown(third))

    last = after("sequence_packing", fourth).collect()
    plain = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    pieces = Counter()
    for r in fourth.collect():
        ids = plain.encode(r.text or "", add_special_tokens=False).ids + [2]
        edges = [0, *range(len(ids) % 1024 or min(1024, len(ids)), len(ids) + 1, 1024)]
        pieces.update((r.doc_id, k, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())) for k, (a, b) in enumerate(zip(edges, edges[1:], strict=False)))
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in last) == pieces
    held = defaultdict(list)
    for r in last:
        held[r.sequence_id].append((r.offset, r.length))
    for parts in held.values():
        parts.sort()
        assert [o for o, _ in parts] == [sum(n for _, n in parts[:k]) for k in range(len(parts))] and sum(n for _, n in parts) <= 1024
