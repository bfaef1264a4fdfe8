"""Lists inside a row as maps, so that looking things up does not scan a list of records for each look-up."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def evaluated_once(value: Column, use) -> Column:
    """``use(value)`` with the value computed a single time for the row, also where lambdas refer to it."""
    return F.aggregate(F.array(), value, lambda kept, _: kept, use)  # copies nothing, see ``model.let``


def index_of(entries: Column, last: bool = True) -> Column:
    """Map of an array of ``struct<key, value>``; of equal keys the last (or first) entry counts, null keys are left out.

    Sorting brings equal keys together, so no session-wide setting for repeated map keys is needed.
    """
    place = (lambda i: i) if last else (lambda i: -i)
    placed = F.transform(
        F.filter(entries, lambda e: e["key"].isNotNull()),
        lambda e, i: F.struct(e["key"].alias("key"), place(i).alias("place"), e["value"].alias("value")),
    )

    def final(ordered: Column) -> Column:
        is_last = lambda e, i: ~F.coalesce(F.get(ordered, i + 1)["key"] == e["key"], F.lit(False))
        return F.map_from_entries(F.transform(F.filter(ordered, is_last), lambda e: F.struct(e["key"], e["value"])))

    return evaluated_once(F.array_sort(placed), final)
