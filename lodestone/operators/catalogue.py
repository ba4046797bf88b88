"""The application catalogue: several sources, one entry a target."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Fixed value: sources from the most to the least trusted.
SOURCES = ("app-paths", "start-menu", "windows-apps", "path")


def deduplicated(apps: DataFrame) -> DataFrame:
    """The best entry of each target, case aside: the most trusted source's, then the first seen. Blank targets go.

    An aggregate, so hot targets are combined before the shuffle.
    """
    rank = F.array_position(F.array(*map(F.lit, SOURCES)), F.col("app_source"))
    names = apps.columns
    best = (
        apps.where(F.trim("target") != "")
        .groupBy(F.lower("target").alias("__key"))
        .agg(F.min_by(F.struct(*names), F.struct(rank, F.col("collect_ord"))).alias("__best"))
    )
    return best.select(*(F.col(f"__best.{n}").alias(n) for n in names))


def in_order(apps: DataFrame) -> DataFrame:
    return apps.orderBy(F.lower("name"), "target")


def per_source(apps: DataFrame) -> DataFrame:
    return apps.groupBy("app_source").agg(F.count("*").alias("n"))
