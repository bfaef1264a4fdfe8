"""Intermediate tables in a folder that all executors see."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession, name: str) -> str:
    """New folder below ``spark.checkpoint.dir``.

    A local session without that setting gets a temporary folder; any other one fails, because its executors
    would each write to a disk of their own.
    """
    key = "spark.checkpoint.dir"
    shared = spark.conf.get(key, None) or spark.sparkContext.getConf().get(key, None)
    if not shared:
        if not spark.sparkContext.master.startswith(("local[", "local")) or "cluster" in spark.sparkContext.master:
            raise ValueError(f"{key} must name a folder that all executors share")
        shared = tempfile.mkdtemp(prefix="marklake-")
    return f"{shared.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write the rows once and read them back, which also cuts the lineage."""
    path = shared_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
