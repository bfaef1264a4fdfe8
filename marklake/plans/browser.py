"""Bookmarks of a browser's profiles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from marklake.operators.bookmark_tree import flatten_bookmark_tree
from marklake.sources.files import read_browser_bookmarks


def browser_bookmarks(spark: SparkSession, root: str, browser: str) -> tuple[DataFrame, DataFrame]:
    """``(bookmarks, failures)`` over all profiles below ``root``.

    Raises for an unknown browser, when there is no bookmark file and when no
    file holds a bookmark.
    """
    bookmarks, failures = flatten_bookmark_tree(read_browser_bookmarks(spark, root, browser))
    if bookmarks.isEmpty():
        raise ValueError(f"no bookmarks found below {root}")
    return bookmarks, failures
