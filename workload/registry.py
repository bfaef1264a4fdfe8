"""Registry of driver queries and their oracle SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from marklake.storage import shared_dir, stage

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn

    return register


def work_dir(spark: SparkSession, name: str) -> str:
    """New folder for tables a job writes, shared by all executors."""
    return shared_dir(spark, name)


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows as a table on disk, for operators that read their input more than once."""
    return stage(df, name)
