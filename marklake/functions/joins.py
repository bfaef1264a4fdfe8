"""How a list of ids meets rows with long texts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Ids that every task may hold; a longer list is dealt, and a task holds its share.
MOST_BROADCAST = 200_000


def as_lookup(ids: DataFrame, most: int = MOST_BROADCAST) -> DataFrame:
    """``ids``, to be the right side of a semi or anti join, marked to be hashed: the left side is streamed past them.

    Spark's own choice for two large sides sorts both of them, and texts that are hundreds of times as long as the ids fill
    a task's memory or its disk. Of repeated ids a task holds one.
    """
    return F.broadcast(ids) if ids.limit(most + 1).count() <= most else ids.hint("shuffle_hash")
