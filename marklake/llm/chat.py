"""Chat formatting by incremental black-box rendering.

A template is any function from a list of (role, text) turns to a string. The successive prefixes of a conversation
are rendered and consecutive outputs compared: a turn's span is what its prefix adds to the one before, and a template
whose output doesn't begin with the one before has rewritten history. The place of a turn's text within its span is found
by rendering the prefix once more with a mark as the last text. Training loss covers the texts of assistant turns.

Prefixes are those of the whole conversation, however long it is, and all of them are rendered. A black box offers no
shortcut: n turns take 2 n renderings of up to the whole text. Conversations are partitioned by id, sorted by turn on disk
and streamed; every one is held by its task while it is rendered. The prefixes of a conversation that would keep a task too
long (``SPREAD``) are dealt to tasks by stretches of equal work, each of which gets the turns up to its end, and the spans
are put together. A conversation's output is one string, which ends at 2 GB. Only a caller who gives ``most_rendered``
leaves longer ones out: their rows have null for everything but the number of turns.

Fixed results: a null id is a conversation of its own; turns are ordered by (turn, role, text), nulls first; repeated
rows are turns of their own; a null role or text counts as empty; an empty table gives no row; extra columns are
ignored. A conversation whose history was rewritten has no spans (-1) and no loss.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marklake.functions.joins import as_lookup
from marklake.storage import stage

Turns = list[tuple[str, str]]
Template = Callable[[Turns], str]

#: Characters that a stretch of prefixes renders; conversations that render more are spread over tasks by stretches.
SPREAD = 1 << 28
#: What a turn costs beside its characters, in characters.
PER_TURN = 64
#: A stretch renders this many times the conversation at least, so that little is moved for what is rendered.
LEAST_PASSES = 64
MARK = "\U0010fffd\U0010fffc\U0010fffd"

BEGIN, CLOSE, OPEN_USER, CLOSE_USER, SYSTEM, OTHER = "<s>", "</s>", "[INST]", "[/INST]", "[SYSTEM]", "[ROLE]"
CONTROLS = (BEGIN, CLOSE, OPEN_USER, CLOSE_USER, SYSTEM, OTHER)
_STARTS = re.compile("|".join(f"{re.escape(c[0])}(?={re.escape(c[1:])})" for c in CONTROLS))
_ESCAPED = re.compile(r"\\(.)", re.DOTALL)
_TURN = re.compile(r"\[INST\] (?P<user>.*?) \[/INST\]|\[SYSTEM\] (?P<system>.*?) </s>|\[ROLE\] (?P<role>.*?) \[ROLE\] (?P<other>.*?) </s>|<s> (?P<assistant>.*?) </s>", re.DOTALL)


def escape(text: str) -> str:
    """Text in which no control string is left: a backslash goes behind the first character of each, and is doubled."""
    return _STARTS.sub(lambda m: m[0] + "\\", text.replace("\\", "\\\\"))


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


def _turn(role: str, text: str) -> str:
    body = escape(text)
    if role == "user":
        return f"{OPEN_USER} {body} {CLOSE_USER}"
    if role == "assistant":
        return f"{BEGIN} {body} {CLOSE}"
    if role == "system":
        return f"{SYSTEM} {body} {CLOSE}"
    return f"{OTHER} {escape(role)} {OTHER} {body} {CLOSE}"


_short_turn = lru_cache(maxsize=2048)(_turn)


def instruction_template(turns: Turns) -> str:
    """User turns between [INST] and [/INST], answers between <s> and </s>, other roles by name."""
    return "".join([_short_turn(r, t) if len(t) + len(r) < 8192 else _turn(r, t) for r, t in turns])


instruction_template.turn = _turn


def parse(formatted: str) -> Turns:
    """The turns of ``instruction_template``'s output."""
    out, at = [], 0
    while at < len(formatted):
        found = _TURN.match(formatted, at)
        if not found:
            raise ValueError(f"no turn at {at}")
        at = found.end()
        kind = found.lastgroup
        role = unescape(found["role"]) if kind == "other" else kind
        out.append((role, unescape(found[kind])))
    return out


def _span(turns: Turns, template: Template, before: str, now: str) -> tuple[int, int, int, int]:
    """(start, end, text start, text end) of the last turn, where ``now`` adds it to ``before``."""
    probe = template([*turns[:-1], (turns[-1][0], MARK)])
    at = probe.find(MARK, len(before))
    tail = len(probe) - at - len(MARK)
    held = at >= 0 and probe[:at] == now[:at] and (tail == 0 or probe[-tail:] == now[-tail:])
    return (len(before), len(now), at, len(now) - tail) if held else (len(before), len(now), -1, -1)


def render(turns: Turns, template: Template) -> tuple[str, list[tuple[int, int, int, int]], int]:
    """Output, (start, end, text start, text end) of each turn, and the first turn whose prefix rewrote the one before
    (-1: none). Where one did, places in earlier prefixes mean nothing in the output, and no span is given."""
    spans, before, rewritten = [], template([]), -1
    for i in range(len(turns)):
        now = template(turns[: i + 1])
        if rewritten < 0 and not now.startswith(before):
            rewritten = i
        spans.append((-1, -1, -1, -1) if rewritten >= 0 else _span(turns[: i + 1], template, before, now))
        before = now
    if rewritten >= 0:
        spans = [(-1, -1, -1, -1)] * len(spans)
    return before, spans, rewritten


def render_by_turn(turns: Turns, turn: Callable[[str, str], str]) -> tuple[str, list[tuple[int, int, int, int]], int]:
    """What ``render`` gives for the template that joins ``turn(role, text)`` of all turns; nothing is compared, so
    ``format_conversations`` doesn't use it."""
    parts, spans, start = [], [], 0
    for role, text in turns:
        now, probe = turn(role, text), turn(role, MARK)
        at = probe.find(MARK)
        tail = len(probe) - at - len(MARK)
        held = at >= 0 and probe[:at] == now[:at] and (tail == 0 or probe[-tail:] == now[-tail:])
        end = start + len(now)
        spans.append((start, end, start + at, end - tail) if held else (start, end, -1, -1))
        parts.append(now)
        start = end
    return "".join(parts), spans, -1


SCHEMA = "conv_id string, n_turns long, formatted string, span_start array<long>, span_end array<long>, text_start array<long>, text_end array<long>, rewritten int"
READ = "conv_id string, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, rewritten boolean"


def _names(ddl: str) -> list[str]:
    return [c.split()[0] for c in ddl.split(", ")]


STRETCH = "conv_id string, n long, span_start long, span_end long, text_start long, text_end long, rewrites boolean, formatted string"


def _spread(turns: DataFrame, order: list, template: Template) -> DataFrame:
    """Columns of ``SCHEMA`` for long conversations, the prefixes of each rendered by many tasks.

    A turn goes to the stretch that renders its prefix (``own``) and to all later ones, whose prefixes hold it too.
    """
    whole = Window.partitionBy("conv_id")
    upto = whole.orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    each = turns.withColumn("n", F.row_number().over(whole.orderBy(*order)).cast("long")).withColumn("chars", F.sum("size").over(upto))
    each = each.withColumn("work", F.sum("chars").over(upto) - F.col("chars"))
    share = F.greatest(F.lit(SPREAD).cast("long"), F.max("chars").over(whole) * LEAST_PASSES)
    each = each.withColumn("own", F.floor(F.col("work") / share)).withColumn("final", F.col("n") == F.max("n").over(whole))
    each = each.withColumn("last", F.max("own").over(whole))
    dealt = each.select("conv_id", F.explode(F.sequence("own", "last")).alias("stretch"), "n", "role", "text", "own", "final")
    # A given number of partitions isn't merged by size: these rows are few for the time that they take.
    tasks = 4 * turns.sparkSession.sparkContext.defaultParallelism
    dealt = dealt.repartition(tasks, "conv_id", "stretch").sortWithinPartitions(F.col("conv_id").asc_nulls_first(), "stretch", "n")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, held, before = None, [], None
        for frame in frames:
            out = []
            for conv, stretch, n, role, text, own, final in frame.itertuples(index=False):
                if (conv, stretch) != current:
                    current, held, before = (conv, stretch), [], None
                if own == stretch and before is None:
                    before = template(list(held))
                held.append((role, text))
                if own == stretch:
                    now = template(list(held))
                    rewrites = not now.startswith(before)
                    start, end, a, b = (-1, -1, -1, -1) if rewrites else _span(held, template, before, now)
                    out.append((conv, n, start, end, *((a, b) if role == "assistant" else (-1, -1)), rewrites, now if final else None))
                    before = now
            if out:
                yield pd.DataFrame(out, columns=_names(STRETCH))

    places = ("span_start", "span_end", "text_start", "text_end")
    found = dealt.mapInPandas(run, STRETCH).groupBy("conv_id").agg(
        F.count("*").alias("n_turns"),
        F.max("formatted").alias("formatted"),
        F.array_sort(F.collect_list(F.struct("n", *places))).alias("spans"),
        F.coalesce(F.min(F.when(F.col("rewrites"), F.col("n") - 1)), F.lit(-1)).cast("int").alias("rewritten"),
    )

    def kept(place: str) -> Column:
        return F.transform("spans", lambda s: F.when(F.col("rewritten") < 0, s[place]).otherwise(F.lit(-1))).alias(place)

    return found.select("conv_id", "n_turns", "formatted", *map(kept, places), "rewritten")


def format_conversations(rows: DataFrame, template: Template = instruction_template, most_rendered: int | None = None) -> DataFrame:
    """A row for each conversation: ``conv_id``, ``n_turns``, ``formatted``, the spans of its turns and texts,
    ``rewritten`` (the first turn that rewrote history; -1: none).

    ``text_start`` and ``text_end`` are the loss mask: -1 for turns that carry no loss. Which conversations are long is
    counted when this is called, except where ``most_rendered`` bounds them.
    """
    turns = rows.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    kind = turns.schema["conv_id"].dataType
    turns = turns.withColumn("conv_id", F.col("conv_id").cast("string"))  # pandas has no whole numbers with nulls
    order = [F.col(c).asc_nulls_first() for c in ("conv_id", "turn", "role", "text")]

    def row_of(conv, n: int, held: Turns | None) -> tuple:
        if held is None:
            return (conv, n, None, None, None, None, None, None)
        text, spans, rewritten = render(held, template)
        loss = [role == "assistant" for role, _ in held]
        masks = [(a, b) if on else (-1, -1) for on, (*_, a, b) in zip(loss, spans, strict=True)]
        return (conv, n, text, [s[0] for s in spans], [s[1] for s in spans], [m[0] for m in masks], [m[1] for m in masks], rewritten)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: Turns | None = []
        current, n, length, work, out, size = None, 0, 0, 0, [], 0
        for frame in frames:
            for conv, role, text in zip(frame["conv_id"], frame["role"], frame["text"], strict=True):
                if n and conv != current:
                    out.append(row_of(current, n, held))
                    size += len(out[-1][2] or "")
                    held, n, length, work = [], 0, 0, 0
                    if size > 8 << 20:
                        yield pd.DataFrame(out, columns=_names(SCHEMA))
                        out, size = [], 0
                current, n = conv, n + 1
                length += len(role) + len(text)
                work += 2 * length
                if most_rendered is not None and work > most_rendered:
                    held = None
                if held is not None:
                    held.append((role, text))
        if n:
            out.append(row_of(current, n, held))
        if out:
            yield pd.DataFrame(out, columns=_names(SCHEMA))

    def by_conversation(some: DataFrame) -> DataFrame:
        return some.repartition("conv_id").sortWithinPartitions(*order).mapInPandas(run, SCHEMA)

    if most_rendered is None:
        sized = turns.withColumn("size", (F.length("role") + F.length("text") + PER_TURN).cast("long"))
        totals = sized.groupBy(F.col("conv_id").alias("l_id")).agg(F.count("*").cast("double").alias("n"), F.sum("size").alias("chars"))
        long = stage(totals.where(F.col("n") * F.col("chars") > 2 * SPREAD).select("l_id"), "long_conversations")
        if not long.isEmpty():
            ids, same = as_lookup(long), F.col("conv_id").eqNullSafe(F.col("l_id"))
            short = by_conversation(turns.join(ids, same, "left_anti"))
            out = short.unionByName(_spread(sized.join(ids, same, "left_semi"), order[1:], template))
            return out.withColumn("conv_id", F.col("conv_id").cast(kind))
    return by_conversation(turns).withColumn("conv_id", F.col("conv_id").cast(kind))


def read_back(formatted: DataFrame) -> DataFrame:
    """What each row of ``format_conversations`` holds, parsed from its output: ``n_turns``, ``turns_sha256``,
    ``loss_chars``, ``loss_sha256``, ``formatted_chars``, ``rewritten``; null where nothing was rendered."""
    kind = formatted.schema["conv_id"].dataType

    def read(row) -> tuple:
        if row.formatted is None:
            return (row.conv_id, row.n_turns, None, None, None, None, None)
        turns, loss, n, chars = hashlib.sha256(), hashlib.sha256(), 0, 0
        for role, text in parse(row.formatted):
            turns.update(f"{role}\n{text}\n".encode())
            n += 1
        for a, b in zip(row.text_start, row.text_end, strict=True):
            if a >= 0:
                text = unescape(row.formatted[a:b])
                loss.update(text.encode())
                chars += len(text)
        return (row.conv_id, n, turns.hexdigest(), chars, loss.hexdigest(), len(row.formatted), row.rewritten >= 0)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield pd.DataFrame([read(row) for row in frame.itertuples(index=False)], columns=_names(READ))

    out = formatted.withColumn("conv_id", F.col("conv_id").cast("string")).mapInPandas(run, READ)
    return out.withColumn("conv_id", F.col("conv_id").cast(kind))
