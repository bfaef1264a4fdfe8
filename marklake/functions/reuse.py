"""Expressions built once per JVM.

An extracted post holds about two thousand expressions and building each of
them is a call from Python to the JVM, about a second in all. Unresolved
columns are not tied to a DataFrame, so they are kept and used again.
"""

from __future__ import annotations

from collections.abc import Callable, Hashable
from typing import TypeVar

from pyspark import SparkContext

T = TypeVar("T")

_kept: dict[Hashable, tuple[object, object]] = {}


def once_per_jvm(key: Hashable, build: Callable[[], T]) -> T:
    gateway = SparkContext._gateway
    held = _kept.get(key)
    if held is None or held[0] is not gateway:
        held = _kept[key] = (gateway, build())
    return held[1]
