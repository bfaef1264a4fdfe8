"""Record validation: good rows and the violated paths of bad ones."""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marklake import model
from marklake.model import let, violations
from marklake.operators.documents import _item_at, _resolve_slot, _slots, key_columns, resolve_documents


@lru_cache(maxsize=2)
def _violations_sql(strict: bool) -> str:
    root = f"d.{model.ROOT_KEY}.instructions"
    shape = model._joined(violations(root, model.INSTRUCTIONS, "instructions", strict))
    inside = model._joined(
        violations("item.tweet_results.result.tweet", model.POST, "result.tweet", strict)
    )
    slot = (
        "CASE WHEN item.tweet_results.result IS NULL THEN array('tweet_results.result') "
        "WHEN item.tweet_results.result.tweet IS NULL THEN array('result') "
        f"ELSE {let('inner_paths', inside, 'CASE WHEN size(inner_paths) > 0 THEN inner_paths ELSE array(' + repr('result') + ') END')} END"
    )
    checked = let(
        "x",
        _resolve_slot("d", "s", strict),
        f"CASE WHEN x.status = 'invalid' THEN {slot} ELSE cast(array() AS array<string>) END",
    )
    per_slot = let("item", _item_at("d", "s"), checked)
    posts = f"flatten(transform({_slots('d', strict)}, s -> {per_slot}))"
    found = let(
        "shape",
        shape,
        f"CASE WHEN {root} IS NULL THEN array('instructions') "
        f"WHEN size(shape) > 0 THEN shape ELSE {posts} END",
    )
    ddl = model.conversation_ddl(strict)
    return (
        f"inline(transform(array(from_json(raw, '{ddl}')), "
        f"d -> named_struct('violations', array_sort(array_distinct({found})))))"
    )


def validate_conversations(
    conversations: DataFrame, *, strict: bool = False
) -> tuple[DataFrame, DataFrame]:
    """Returns ``(valid raw rows, violations(key.., violations))``.

    One bad entry makes its whole document invalid. The paths name the record
    field, with ``[]`` for list items.
    """
    keys = key_columns(conversations)
    checked = conversations.select(*keys, "raw", F.expr(_violations_sql(strict)))
    bad = F.size("violations") > 0
    return (
        checked.where(~bad).drop("violations"),
        checked.where(bad).select(*keys, "violations"),
    )


def validation_status(conversations: DataFrame, *, strict: bool = False) -> DataFrame:
    """``key.., is_valid, reason`` for every document, good or bad."""
    resolved = resolve_documents(conversations, strict=strict, extraction=False)
    return resolved.select(
        *key_columns(resolved), F.col("stage").isNull().alias("is_valid"), "reason"
    )
