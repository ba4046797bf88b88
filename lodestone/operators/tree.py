"""Path trees: full paths from parent links, level by level.

Each round joins the level's rows with their children on the parent's id and writes the next level; rows that no root
reaches (orphans, cycles) never join, so they drop out. Names are stored once, and a lost executor costs its tasks only.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.sources.scratch import shared_dir

MOST_DEPTH = 1024


def paths(tree: DataFrame, separator: str = "\\", most_depth: int = MOST_DEPTH) -> DataFrame:
    """tree(id, parent_id, name) -> id, path, depth. Roots have no parent, themselves or 0 as parent, and end in a separator.

    The levels are written as they are found, so that neither their number nor their sizes have a limit but most_depth.
    """
    spark = tree.sparkSession
    at = f"{shared_dir(spark)}/lodestone/paths-{uuid.uuid4().hex}"
    rows = tree.select(F.col("id").cast("long").alias("id"), F.col("parent_id").cast("long").alias("parent_id"), F.col("name").cast("string").alias("name"))
    top = F.col("parent_id").isNull() | (F.col("parent_id") == F.col("id")) | (F.col("parent_id") == 0)
    rows.where(top).select("id", F.col("name").alias("path")).write.parquet(f"{at}/depth=0")
    below = rows.where(~top)
    for depth in range(most_depth):
        level = spark.read.schema("id long, path string").parquet(f"{at}/depth={depth}")
        if level.isEmpty():
            break
        above = level.select(F.col("id").alias("__p"), F.rtrim("path", F.lit(separator)).alias("__above"))
        found = below.join(above, F.col("parent_id") == F.col("__p")).select("id", F.concat("__above", F.lit(separator), "name").alias("path"))
        found.write.parquet(f"{at}/depth={depth + 1}")
    else:
        raise RecursionError(f"paths are deeper than {most_depth}")
    return spark.read.schema("id long, path string, depth int").option("basePath", at).parquet(at)


def consistency(tree: DataFrame) -> DataFrame:
    """Live rows whose parent is not there: none if the index is consistent."""
    live = tree.where("NOT coalesce(is_deleted, false)")
    parents = tree.select(F.col("id").alias("__p"))
    return live.where("parent_id IS NOT NULL").join(parents, F.col("parent_id") == F.col("__p"), "left_anti")


def statistics(tree: DataFrame) -> DataFrame:
    """file_count, directory_count (of live rows) and deleted_count."""
    live = ~F.coalesce(F.col("is_deleted"), F.lit(False))
    return tree.agg(
        F.count_if(live & ~F.col("is_dir")).alias("file_count"),
        F.count_if(live & F.col("is_dir")).alias("directory_count"),
        F.count_if(~live).alias("deleted_count"),
    )
