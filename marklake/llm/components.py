"""Connected components of a link table, by large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marklake.storage import stage


def _to_least(edges: DataFrame) -> DataFrame:
    """``u``, ``v`` and the least of u and all its neighbours."""
    least = edges.groupBy(F.col("u").alias("of")).agg(F.min("v").alias("least"))
    return edges.join(least, edges["u"] == least["of"]).select("u", "v", F.least("least", "u").alias("m"))


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``node``, ``root`` (least node of its component) for each node with a link.

    Every step is a minimum per node and a join, so a node with very many links is only a skewed join key. Steps are
    written to the shared folder; their number grows with the logarithm of the longest path.
    """
    edges = stage(links.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u != v").distinct(), "links")
    before = None
    while True:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _to_least(both).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u != v").distinct()
        down = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        small = _to_least(down)
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).union(small.select("u", F.col("m").alias("v")))
        edges = stage(small.where("u != v").distinct(), "links")
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    roots = edges.select(F.col("v").alias("u")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).union(roots.select("u", F.col("u").alias("root")))
