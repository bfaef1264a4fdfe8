"""Browser bookmark trees flattened to rows."""

from __future__ import annotations

from itertools import count

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType

from marklake.functions.scalars import webkit_date
from marklake.storage import shared_dir

NODE_DDL = "struct<type:string,name:string,url:string,date_added:string,children:array<string>>"
LEVELS = 4


def _roots(files: DataFrame, keys: list[str]) -> DataFrame:
    roots = F.from_json("raw", "struct<roots:map<string,string>>")["roots"]
    # A file without readable roots keeps one row that marks it as broken.
    listed = F.coalesce(
        F.map_entries(roots), F.array(F.lit(None).cast("struct<key:string,value:string>"))
    )
    return files.select(*keys, F.posexplode(listed).alias("at", "root")).select(
        *keys,
        F.array("at").alias("path"),
        F.col("root.key").alias("folder"),
        F.array().cast("array<string>").alias("folder_path"),
        F.from_json("root.value", NODE_DDL).alias("node"),
    )


def _is_folder() -> Column:
    # A nameless folder with children stays, for the caller to see that it is broken.
    named = F.col("node.name").isNotNull() | (F.size("node.children") == 0)
    return F.coalesce((F.col("node.type") == "folder") & F.col("node.children").isNotNull() & named, F.lit(False))


def _opened(rows: DataFrame, keys: list[str], levels: int) -> DataFrame:
    """Folders give way to their children, ``levels`` times; everything else stays as it is."""
    for _ in range(levels):
        # One chain of generators, so no level is computed twice.
        step = F.when(
            _is_folder(),
            F.transform(
                F.col("node.children"),
                lambda child, i: F.struct(
                    F.concat("path", F.array(i)).alias("path"),
                    F.col("node.name").alias("folder"),
                    F.concat("folder_path", F.array("node.name")).alias("folder_path"),
                    F.from_json(child, NODE_DDL).alias("node"),
                ),
            ),
        ).otherwise(F.array(F.struct("path", "folder", "folder_path", "node")))
        rows = rows.select(*keys, F.explode(step).alias("n")).select(*keys, "n.*")
    return rows


def _walk(files: DataFrame, keys: list[str], levels: int) -> DataFrame:
    """Leaf rows of every tree: bookmarks, ignored nodes and broken nodes.

    Folders are a frontier that moves down ``levels`` levels a round. A round is written, its leaves stay where they are,
    and the folders that are left make the next one; an empty frontier ends the loop. So plans don't grow with the deepest
    file, and files that are done take no part in the rounds that deeper ones need.
    """
    spark = files.sparkSession
    root = shared_dir(spark, "bookmark-levels")
    frontier = _roots(files, keys)
    for level in count():
        rows = _opened(frontier, keys, levels).withColumn("open", _is_folder())
        rows.write.parquet(f"{root}/level={level}")
        frontier = spark.read.schema(rows.schema).parquet(f"{root}/level={level}").where("open").drop("open")
        if frontier.isEmpty():
            break
    return spark.read.schema(rows.schema.add("level", IntegerType())).parquet(root).where("NOT open").drop("open", "level")


def flatten_bookmark_tree(files: DataFrame, levels: int = LEVELS) -> tuple[DataFrame, DataFrame]:
    """Bookmarks of ``files(file, .., raw)`` and the files that cannot be read.

    Returns ``(bookmarks, failures)``. Bookmarks carry ``name, url, folder,
    date_added, path, folder_path``: ``folder`` is the name of the direct
    parent (the root's key for a bookmark that is itself a root) and ``path``
    sorts in depth-first order. A file with a broken node (no type, a folder
    without a list of children, a nameless folder that has some, a bookmark
    without name, address or date) gives no bookmark at all. Folders may be nested
    to any depth; ``levels`` of them are opened in one pass.
    """
    keys = [c for c in files.columns if c != "raw"]
    leaves = _walk(files, keys, levels)
    node = F.col("node")
    when_added = node["date_added"].try_cast("bigint")
    bad = (
        node["type"].isNull()
        | (node["type"] == "folder")
        & (node["children"].isNull() | node["name"].isNull() & (F.size(node["children"]) > 0))
        | (node["type"] == "url")
        & (node["name"].isNull() | node["url"].isNull() | when_added.isNull())
    )
    broken = leaves.where(F.coalesce(bad, F.lit(True))).select("file").distinct()
    good = (
        leaves.where(node["type"] == "url")
        .join(broken, "file", "left_anti")
        .select(
            *keys,
            node["name"].alias("name"),
            node["url"].alias("url"),
            "folder",
            webkit_date(node["date_added"]).alias("date_added"),
            "path",
            "folder_path",
        )
    )
    failed = broken.select(
        "file", F.lit("flatten").alias("stage"), F.lit("broken bookmark node").alias("reason")
    )
    return good, failed


def preview(bookmarks: DataFrame, n: int = 10) -> DataFrame:
    """The first ``n`` bookmarks in depth-first order."""
    order = [c for c in ("file", "path") if c in bookmarks.columns]
    return bookmarks.orderBy(*order).limit(n)
