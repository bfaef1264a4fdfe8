"""From raw conversation JSON to resolved post slots, one row per document.

Everything here works inside the row: a document is parsed once, checked,
and turned into an array of slots (one per timeline item) without a shuffle.
Later operators either explode the slots or keep working on the array.
"""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marklake import model
from marklake.model import integer, let, one_of, text, valid

# Entry id prefixes of the timeline.
MAIN_PREFIX = "tweet-"
RELATED_PREFIX = "tweetdetailrelatedtweets"
CURSOR_PREFIX = "cursor"

WRAPPER_KINDS = ("Tweet", "UserUnavailable", "TweetWithVisibilityResults")


def _spans(path: str, strict: bool) -> str:
    return (
        f"transform({path}, u -> named_struct("
        f"'url', {text('u.url', strict)}, 'expanded_url', {text('u.expanded_url', strict)}, "
        f"'indices', transform(u.indices, n -> {integer('n')})))"
    )


def _variants(path: str, strict: bool) -> str:
    return (
        f"transform({path}, x -> named_struct("
        f"'content_type', {text('x.content_type', strict)}, 'url', {text('x.url', strict)}, "
        f"'bitrate', {integer('x.bitrate')}))"
    )


def _media(path: str, strict: bool) -> str:
    texts = ("id_str", "media_key", "url", "expanded_url", "display_url", "media_url_https")
    plain = ", ".join(f"'{n}', {text(f'm.{n}', strict)}" for n in texts)
    return (
        f"transform({path}, m -> named_struct({plain}, 'type', m.type, "
        f"'indices', transform(m.indices, n -> {integer('n')}), "
        "'video_info', CASE WHEN m.video_info IS NOT NULL THEN named_struct("
        f"'aspect_ratio', transform(m.video_info.aspect_ratio, n -> {integer('n')}), "
        f"'duration_millis', {integer('m.video_info.duration_millis')}, "
        f"'variants', {_variants('m.video_info.variants', strict)}) END))"
    )


def _article(path: str, strict: bool) -> str:
    r = f"{path}.article_results.result"
    info = "a.media_info"
    return (
        f"CASE WHEN {path} IS NOT NULL THEN named_struct("
        f"'title', {text(f'{r}.title', strict)}, 'preview_text', {text(f'{r}.preview_text', strict)}, "
        f"'has_body', {r}.content_state IS NOT NULL, "
        f"'blocks', transform({r}.content_state.blocks, b -> named_struct("
        f"'type', {text('b.type', strict)}, 'text', {text('b.text', strict)}, "
        "'has_range', coalesce(size(b.entityRanges), 0) > 0, "
        "'entity_key', coalesce(get(b.entityRanges, 0).key, ''))), "
        f"'entities', transform({r}.content_state.entityMap, e -> named_struct("
        f"'key', {text('e.key', strict)}, 'type', coalesce(e.value.type, ''), "
        "'n_items', coalesce(size(e.value.data.mediaItems), 0), "
        "'media_id', coalesce(get(e.value.data.mediaItems, 0).mediaId, ''), "
        "'markdown', coalesce(e.value.data.markdown, ''), "
        "'post_id', coalesce(e.value.data.tweetId, ''))), "
        f"'media', transform(coalesce({r}.media_entities, array()), a -> named_struct("
        f"'media_id', {text('a.media_id', strict)}, 'kind', {text(f'{info}.__typename', strict)}, "
        f"'image_url', {text(f'{info}.original_img_url', strict)}, "
        f"'preview_url', {text(f'{info}.preview_image.original_img_url', strict)}, "
        f"'duration_millis', {integer(f'{info}.duration_millis')}, "
        f"'variants', {_variants(f'{info}.variants', strict)}))) END"
    )


def _lean_post(p: str, strict: bool, quoted: bool = False) -> str:
    """The part of a valid post that later operators read; quotes show no card and no article."""
    user = f"{p}.core.user_results.result.core"
    note = f"{p}.note_tweet.note_tweet_results.result"
    leg, ent = f"{p}.legacy", f"{p}.legacy.entities"
    return (
        "named_struct("
        f"'rest_id', {text(f'{p}.rest_id', strict)}, "
        f"'name', {text(f'{user}.name', strict)}, 'screen_name', {text(f'{user}.screen_name', strict)}, "
        f"'full_text', {text(f'{leg}.full_text', strict)}, "
        f"'created_at', {text(f'{leg}.created_at', strict)}, "
        f"'favorite_count', {integer(f'{leg}.favorite_count')}, "
        f"'reply_count', {integer(f'{leg}.reply_count')}, "
        f"'retweet_count', {integer(f'{leg}.retweet_count')}, "
        f"'urls', {_spans(f'{ent}.urls', strict)}, "
        f"'mentions', transform({ent}.user_mentions, t -> {text('t.screen_name', strict)}), "
        f"'hashtags', {ent}.hashtags, "
        f"'media', coalesce({_media(f'{ent}.media', strict)}, array()), "
        f"'permalink', {text(f'{leg}.quoted_status_permalink.expanded', strict)}, "
        f"'note', CASE WHEN {p}.note_tweet IS NOT NULL THEN named_struct("
        f"'text', {text(f'{note}.text', strict)}, 'urls', {_spans(f'{note}.entity_set.urls', strict)}) END"
        + (")" if quoted else f", {_extras(p, strict)})")
    )


def _extras(p: str, strict: bool) -> str:
    return (
        f"'card', CASE WHEN {p}.card IS NOT NULL THEN transform({p}.card.legacy.binding_values, "
        f"c -> named_struct('key', {text('c.key', strict)}, 'value', c.value)) END, "
        f"'article', {_article(f'{p}.article', strict)}"
    )


def _candidate(p: str) -> str:
    """A post cut to the modelled fields, so plain and wrapped posts share one type."""
    fields = ", ".join(f"'{n}', {p}.`{n}`" for n in model.POST)
    return f"CASE WHEN {p} IS NOT NULL THEN named_struct({fields}) END"


def _outcome(r: str, plain_ok: str, wrapped_ok: str) -> str:
    """Which member of the post union ``r`` is; first matching row wins."""
    return (
        "CASE "
        f"WHEN {plain_ok} THEN 'plain' "
        f"WHEN {wrapped_ok} AND ({r}.__typename IS NULL OR {one_of(f'{r}.__typename', WRAPPER_KINDS)}) THEN 'wrapped' "
        f"WHEN {r}.__typename = 'Tweet' AND ({r}.tweet IS NOT NULL OR {r}.tombstone IS NOT NULL) THEN 'tombstone' "
        f"WHEN {r}.tweet IS NULL AND ({r}.__typename IS NULL OR {one_of(f'{r}.__typename', ('Tweet', 'UserUnavailable'))}) "
        "THEN 'unknown' "
        f"WHEN {r}.__typename = 'TweetTombstone' THEN 'tombstone' "
        "ELSE 'invalid' END"
    )


def _candidates(r: str) -> str:
    plain = f"CASE WHEN {r}.__typename = 'Tweet' THEN {_candidate(r)} END"
    return f"{plain}, {_candidate(f'{r}.tweet')}"


def _resolve_result(r: str, strict: bool) -> str:
    """Struct (status, post, quote) of a non-null post union.

    The plain post, the wrapped post and the posts each of them quotes are put
    in one array, so the validity rule stands in the plan once.
    """
    quoted = (f"{r}.quoted_status_result.result", f"{r}.tweet.quoted_status_result.result")
    every = f"array({', '.join(_candidates(x) for x in (r, *quoted))})"
    quote_outcomes = ", ".join(
        f"CASE WHEN {q} IS NOT NULL THEN {_outcome(q, f'ok[{i}]', f'ok[{i + 1}]')} END"
        for q, i in zip(quoted, (2, 4))
    )
    outcome = _outcome(
        r,
        "(ok[0] AND coalesce(qo[0] <> 'invalid', true))",
        "(ok[1] AND coalesce(qo[1] <> 'invalid', true))",
    )
    chosen = "CASE po WHEN 'plain' THEN 0 WHEN 'wrapped' THEN 1 END"
    lean = let("p", "get(cs, ix)", f"CASE WHEN p IS NOT NULL THEN {_lean_post('p', strict)} END")
    lean_quote = let(
        "p",
        "get(cs, 2 + 2 * ix + CASE get(qo, ix) WHEN 'plain' THEN 0 WHEN 'wrapped' THEN 1 END)",
        f"CASE WHEN p IS NOT NULL THEN {_lean_post('p', strict, quoted=True)} END",
    )
    body = (
        "named_struct('status', CASE WHEN po = 'plain' OR po = 'wrapped' THEN 'post' ELSE po END, "
        f"'post', {lean}, 'quote', CASE WHEN get(qo, ix) IS NOT NULL THEN "
        f"named_struct('status', get(qo, ix), 'post', {lean_quote}) END)"
    )
    return let(
        "cs",
        every,
        let(
            "ok",
            f"transform(cs, c -> {valid('c', model.POST, strict)})",
            let("qo", f"array({quote_outcomes})", let("po", outcome, let("ix", chosen, body))),
        ),
    )


_POSITION = "'instr_pos', cast(ii AS INT), 'entry_pos', cast(ei AS INT), 'item_pos', cast({0} AS INT)"


def _slots(d: str, strict: bool) -> str:
    """Places of all timeline items of a document, in document order, with their roles.

    They are narrow, as lists in lists copy what they hold; ``_item_at`` takes the item itself from its place.
    """
    entry_id = text("e.entryId", strict)
    in_module = "coalesce(size(e.content.items), 0) > 0"

    def slot(pos: str, role: str, lenient: str) -> str:
        return f"named_struct({_POSITION.format(pos)}, 'role', {role}, 'lenient', {lenient})"

    direct_role = (
        "CASE WHEN ins.type <> 'TimelineAddEntries' THEN 'ignored' "
        f"WHEN startswith(id, '{RELATED_PREFIX}') THEN 'ignored' "
        f"WHEN startswith(id, '{MAIN_PREFIX}') THEN 'main' "
        f"WHEN {in_module} THEN 'ignored' "
        f"WHEN startswith(id, '{CURSOR_PREFIX}') THEN 'cursor' ELSE 'reply' END"
    )
    module_role = (
        "CASE WHEN ins.type <> 'TimelineAddEntries' THEN 'ignored' "
        f"WHEN startswith(id, '{RELATED_PREFIX}') OR startswith(id, '{MAIN_PREFIX}') THEN 'ignored' "
        "WHEN it.item.itemContent.tweet_results IS NULL THEN 'ignored' "
        f"WHEN startswith(id, '{CURSOR_PREFIX}') THEN 'cursor' ELSE 'reply' END"
    )
    per_entry = let(
        "id",
        entry_id,
        "concat(CASE WHEN e.content.itemContent IS NOT NULL THEN "
        f"array({slot('0', direct_role, 'false')}) ELSE array() END, "
        f"coalesce(transform(e.content.items, (it, pi) -> {slot('pi', module_role, 'true')}), array()))",
    )
    return (
        f"coalesce(flatten(transform({d}.{model.ROOT_KEY}.instructions, (ins, ii) -> "
        f"coalesce(flatten(transform(ins.entries, (e, ei) -> {per_entry})), array()))), array())"
    )


def _item_at(d: str, s: str) -> str:
    """The item of a slot: that of a module, or the entry's own."""
    content = f"get(get({d}.{model.ROOT_KEY}.instructions, {s}.instr_pos).entries, {s}.entry_pos).content"
    return let("c", content, f"CASE WHEN {s}.lenient THEN get(c.items, {s}.item_pos).item.itemContent ELSE c.itemContent END")


def _resolve_slot(d: str, s: str, strict: bool) -> str:
    """Slot with the (status, post, quote) of its item."""
    missing = (
        f"CASE WHEN {s}.lenient OR (item.itemType = 'TimelineTimelineCursor' "
        "AND item.tweet_results IS NULL) THEN 'missing' ELSE 'invalid' END"
    )
    resolved = let(
        "r",
        "item.tweet_results.result",
        f"CASE WHEN r IS NOT NULL THEN {_resolve_result('r', strict)} END",
    )
    kept = ", ".join(f"'{n}', {s}.{n}" for n in ("instr_pos", "entry_pos", "item_pos", "role"))
    body = f"named_struct({kept}, 'status', coalesce(x.status, {missing}), 'post', x.post, 'quote', CASE WHEN x.quote IS NOT NULL THEN x.quote END)"
    return let("item", _item_at(d, s), let("x", resolved, body))


def _bad_spans(spans: str) -> str:
    return f"coalesce(exists({spans}, u -> size(u.indices) <> 2), false)"


def _breaks_extraction(p: str, with_article: bool) -> str:
    """Valid records whose extraction still fails: broken spans, a video without its details."""
    text_spans = f"CASE WHEN {p}.note IS NOT NULL THEN {_bad_spans(f'{p}.note.urls')} ELSE {_bad_spans(f'{p}.urls')} END"
    if with_article:
        text_spans = f"({p}.article IS NULL AND {text_spans})"
    return (
        f"({p} IS NOT NULL AND ({text_spans} OR {_bad_spans(f'{p}.media')} OR "
        f"coalesce(exists({p}.media, m -> m.type = 'video' AND m.video_info IS NULL), false)))"
    )


@lru_cache(maxsize=8)
def _resolved_sql(keep: tuple[str, ...], strict: bool, whole: bool, extraction: bool) -> str:
    wanted = "(s.role = 'main' OR s.role = 'reply' OR s.role = 'ancestor')"
    breaks = (
        f"exists(slots, s -> {wanted} AND ({_breaks_extraction('s.post', True)} "
        f"OR coalesce({_breaks_extraction('s.quote.post', False)}, false)))"
    )
    # Ancestors of the saved post also arrive as main entries: the last one wins.
    ancestor = "named_struct('instr_pos', s.instr_pos, 'entry_pos', s.entry_pos, 'item_pos', s.item_pos, 'role', 'ancestor', 'lenient', s.lenient)"
    places = let(
        "places",
        _slots("d", strict),
        let(
            "last",
            "array_max(transform(places, (s, i) -> CASE WHEN s.role = 'main' THEN i END))",
            f"transform(places, (s, i) -> CASE WHEN s.role = 'main' AND i <> last THEN {ancestor} ELSE s END)",
        ),
    )
    kept = f"filter(slots, s -> {one_of('s.role', keep)})"
    no_main = "NOT exists(slots, s -> s.role = 'main')" if whole and extraction else "false"
    breaks = breaks if extraction else "false"
    reason = (
        "CASE WHEN d." + model.ROOT_KEY + ".instructions IS NULL THEN 'unreadable document' "
        "WHEN NOT shape_ok THEN 'record shape' "
        "WHEN exists(slots, s -> s.status = 'invalid') THEN 'invalid post' "
        f"WHEN {no_main} THEN 'no main post' "
        f"WHEN {breaks} THEN 'broken span or video' END"
    )
    shape = valid(f"d.{model.ROOT_KEY}.instructions", model.INSTRUCTIONS, strict)
    verdict = (
        "CASE WHEN reason IN ('no main post', 'broken span or video') THEN 'extract' "
        "WHEN reason IS NOT NULL THEN 'validate' END"
    )
    body = let(
        "shape_ok",
        shape,
        let(
            "slots",
            f"transform({places}, s -> {_resolve_slot('d', 's', strict)})",
            let(
                "reason",
                reason,
                f"named_struct('stage', {verdict}, 'reason', reason, "
                f"'slots', CASE WHEN reason IS NULL THEN {kept} END)",
            ),
        ),
    )
    # The one-element array makes `inline` a barrier: filters on its output are
    # not pushed below it, so the document is parsed once per row.
    document = f"from_json(raw, '{model.conversation_ddl(strict)}')"
    return f"inline(array({let('d', document, body)}))"


def key_columns(df: DataFrame) -> list[str]:
    """A document is named by its conversation id and, when it was cut, its part."""
    return ["conv_id", "part"] if "part" in df.columns else ["conv_id"]


def resolve_documents(
    conversations: DataFrame,
    *,
    strict: bool = False,
    keep: tuple[str, ...] = ("main", "reply"),
    extraction: bool = True,
) -> DataFrame:
    """Parse and check ``conversations(conv_id[, part], raw)``.

    Returns the key columns with ``stage``/``reason`` (null when the document
    is good) and ``slots``, the kept timeline items in document order. With a
    ``part`` column a conversation may lie in several rows; whether it has a
    main post is then settled by :func:`settle_parts`. ``extraction=False``
    checks the records only, not whether posts can be extracted from them.
    """
    keys = key_columns(conversations)
    sql = _resolved_sql(tuple(keep), strict, "part" not in keys, extraction)
    return conversations.select(*keys, F.expr(sql))


def failures(resolved: DataFrame) -> DataFrame:
    """Documents that cannot be used: ``conv_id, stage, reason``."""
    return resolved.where(F.col("stage").isNotNull()).select(
        *key_columns(resolved), "stage", "reason"
    )


def settle_parts(documents: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Apply the whole-conversation rules to documents cut into parts.

    ``documents(conv_id, part, stage, reason, main_tweet, ..)``: extracted
    parts. One bad part fails its conversation, a conversation needs a main
    post, and only the main post of the last part that has one counts. Returns
    ``(good, failures)``.

    The verdict is aggregated from narrow columns with a map-side combine. The
    documents only meet the two exception lists (failed conversations, those
    with main posts in several parts), which are short in practice, so AQE can
    broadcast them when their measured size allows. Both results read the
    input: pass a written table.
    """
    has_main = F.col("main_tweet").isNotNull()
    verdict = documents.groupBy("conv_id").agg(
        F.min_by("stage", F.when(F.col("stage").isNotNull(), F.col("part"))).alias("bad_stage"),
        F.min_by("reason", F.when(F.col("stage").isNotNull(), F.col("part"))).alias("bad_reason"),
        F.max(F.when(has_main, F.col("part"))).alias("main_part"),
        F.count_if(has_main).alias("mains"),
    )
    bad = F.col("bad_stage").isNotNull() | F.col("main_part").isNull()
    failed = verdict.where(bad).select(
        "conv_id",
        F.coalesce("bad_stage", F.lit("extract")).alias("stage"),
        F.coalesce("bad_reason", F.lit("no main post")).alias("reason"),
    )
    several = verdict.where(F.col("mains") > 1).select("conv_id", "main_part")
    good = (
        documents.where(F.col("stage").isNull())
        .join(failed.select("conv_id"), "conv_id", "left_anti")
        .join(several, "conv_id", "left")
        .withColumn(
            "main_tweet",
            F.when(F.coalesce(F.col("part") == F.col("main_part"), F.lit(True)), F.col("main_tweet")),
        )
        .drop("main_part", "stage", "reason")
    )
    return good, failed


def explode_slots(resolved: DataFrame) -> DataFrame:
    """One row per kept timeline item: key, ``pos``, positions, role, status, post, quote."""
    keys = key_columns(resolved)
    # The outer form is used because its null rows are dropped after the
    # generator; the inner form would add a size() filter that parses again.
    return (
        resolved.select(*keys, F.posexplode_outer("slots").alias("pos", "slot"))
        .where(F.col("pos").isNotNull())
        .select(*keys, "pos", "slot.*")
    )


def main_slot(slots: Column) -> Column:
    return F.get(F.filter(slots, lambda s: s["role"] == "main"), F.lit(0))
